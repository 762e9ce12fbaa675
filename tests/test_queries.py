"""Every query over the star schema against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from gristmill import catalogue

DATA = "/root/testdata/sf0.001"


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, tables, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    r = tables.execute(catalogue.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    wanted = sorted((tuple(shown(x[names.index(c)]) for c in df.columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(shown, x)) for x in rows), key=repr) == wanted


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["flt_number_text_value", "flt_date_on"])
def test_filters_reach_the_scan(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and ("GreaterThan" in plan) and "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_summary_reads_three_columns(spark):
    plan = catalogue.QUERIES["top_n_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "o_orderkey" not in plan.split("ReadSchema")[1].split(">")[0]
