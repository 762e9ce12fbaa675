"""What keeps tasks small: pages by range, heavy keys in pieces, bounded sets of values."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import analyses, combine, distinct, filters, gram, profile, searching, skew, sorting


def test_pages(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, *range(40)])) for i in range(1003)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    for descending in (False, True):
        pages = sorting.paged(df, "v", descending, tie="id", ranges=6)
        wanted = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
        for size in (50, 400):
            for number in (0, 1, 3, 1003 // size, 1003 // size + 1):
                made = pages.page(number, size)
                assert [tuple(r) for r in made.collect()] == wanted[number * size : (number + 1) * size]
        ranges = min(b - a for a, b in zip(pages.starts, pages.starts[1:], strict=False))
        assert len(pages.parts) == 6 and ranges > 50  # so a page of 50 lies in two at most
        for number in range(0, 20, 3):
            made = pages.page(number, 50)
            assert len(made.select(F.input_file_name()).distinct().collect()) <= 2
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"PartitionFilters: \[[^\]]*_part", plan) and "GreaterThanOrEqual(_n" in plan
    assert sorting.paged(df.where("id < 0"), "v", tie="id").page(0).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "full"])
def test_heavy_keys(spark, how):
    left = [(i, "hot" if i % 2 else "lone" if i % 7 == 0 else None if i % 5 == 0 else f"k{i % 50}") for i in range(2000)]
    right = [(i, "hot" if i < 3 else "other" if i % 3 == 0 else f"k{i % 90}") for i in range(600)]
    a = spark.createDataFrame(left, "a int, lk string").repartition(3)
    b = spark.createDataFrame(right, "b int, rk string").repartition(3)
    plain = a.join(b, F.col("lk") == F.col("rk"), how)
    made = skew.join(a, b, "lk", "rk", how, piece=100)
    assert made.columns == plain.columns and Counter(map(tuple, made.collect())) == Counter(map(tuple, plain.collect()))
    assert Counter(map(tuple, skew.join(a, b, "lk", "rk", how).collect())) == Counter(map(tuple, plain.collect()))
    assert skew.join(a.limit(0), b, "lk", "rk", how, piece=100).count() == (600 if how == "full" else 0)


def test_no_task_has_a_heavy_key(spark):
    """Half of the rows have one key on both sides; no task joins more than a few pieces of it."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        a = spark.range(4000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("_lk"))
        b = spark.range(400).select(F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("_rk"))
        made = skew.join(a, b, "_lk", "_rk", "full", piece=50)
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 * 200 + 2000 + 0 and max(sizes) < 0.2 * sum(sizes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_full_join_of_tables(spark, monkeypatch):
    monkeypatch.setattr(skew.join, "__defaults__", (20,))
    a = spark.createDataFrame([(f" K{i % 3} ", i) for i in range(200)], "key string, v int")
    b = spark.createDataFrame([("k0", 1), ("k9", 2), (None, 3)] + [("K8", 4)] * 50, "key string, v int")
    made = combine.join(a, b, "key", "key", "full")
    assert made.columns == ["key", "v", "v (other)"] and made.count() == 200 + 52
    assert made.where("key = 'K8'").count() == 50 and made.where("trim(key) = 'K0' and `v (other)` = 1").count() == 67


def test_bounded_counts(spark):
    zone = dt.datetime(2024, 1, 1)
    rows = [(i, i % 7, None if i % 3 else float(i % 5), 0.0 if i % 2 else -0.0, zone + dt.timedelta(seconds=i % 30), i % 2 == 0, None, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, few int, holes double, zero double, at timestamp, flag boolean, none string, text string").repartition(4)
    wanted = {"id": 500, "few": 7, "holes": 5, "zero": 1, "at": 30, "flag": 2, "none": 0, "text": 500}
    for limit in (1, 6, 20, 10_000):
        found = distinct.exact(df, df.columns, limit)
        assert {c: n.values for c, n in found.items()} == wanted and found["holes"].missing == 333 and found["none"].missing == 500
        for c, n in distinct.bounded(df, df.columns, limit).items():
            assert n.values == wanted[c] if n.exact else limit < n.values <= wanted[c]
    assert analyses.grouping_columns(df.withColumn("label", F.concat(F.lit("l"), F.col("few")))) == ["flag", "label"]
    assert distinct.exact(df.limit(0), ["id"])["id"] == distinct.Count(0, 0, True) and distinct.exact(df, []) == {}


def test_overview_multiplies_no_rows(spark, monkeypatch):
    plans = []
    inner = distinct.saved
    monkeypatch.setattr(distinct, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or inner(df))
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.lit("x").alias("s"))
    assert [tuple(r) for r in profile.overview(df).collect()] == [("id", "number", 0, 100), ("k", "number", 0, 3), ("s", "category", 0, 1)]
    assert plans and not any("Expand" in p or "Generate" in p for p in plans)


def test_all_pairs_of_columns(spark):
    rnd = random.Random(8)
    names = [f"c{i}" for i in range(13)]
    rows = [[None if rnd.random() < 0.2 else rnd.gauss(1e6, 3) if i else 0.1 for i in range(12)] + [None if r % 400 else 1.0] for r in range(800)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    for block in (5, 512):
        found = {(r.x, r.y): r.r for r in gram.correlations(df, names, block).collect()}
        assert len(found) == 78 and all(found["c0", c] is None for c in names[1:]) and found["c1", "c12"] is None
        for i in range(1, 12):
            for j in range(i + 1, 12):
                both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
                assert found[names[i], names[j]] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)
    assert gram.correlations(df, ["c1"]).count() == 0 and gram.correlations(df.limit(0), ["c1", "c2"]).where("r IS NOT NULL").count() == 0


def test_hundreds_of_columns(spark):
    names = [f"c{i}" for i in range(700)]
    df = spark.range(300).select(*[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)])
    found = {(r.x, r.y): r.r for r in gram.correlations(df, names).where("x = 'c2'").collect()}
    x, y = (np.sin(np.arange(300) * k) for k in (3, 700))
    assert len(found) == 697 and found["c2", "c699"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_search_reads_few_blocks(spark):
    rows = [(i, f"Name{i:05d} of {'ÄBC' if i % 1000 == 7 else 'abc'}", float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, name string, v double").repartitionByRange(20, "id")
    index = searching.indexed(df)
    for query in ("name00123", " NAME0412 ", "äbc", "of", "", "nothing like it", "4999", "e0"):
        wanted = sorted(r.id for r in filters.search(df, query).collect())
        assert sorted(r.id for r in index.search(query).collect()) == wanted, query
    assert len(index.blocks("name00123")) < 20 and index.blocks("nothing like it") == [] and index.blocks("of") is None
    plan = index.search("name00123")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_block", plan)


def test_appending_reads_nothing(spark, tmp_path, monkeypatch):
    from gristmill.functions.values import kind_of
    from gristmill.sources import text as source

    (tmp_path / "a.csv").write_text("id,v,code,day\n" + "".join(f"{i},{i * 1.5},{i:05d},2024-01-{1 + i % 28:02d}\n" for i in range(60)))
    (tmp_path / "b.csv").write_text("ID,v,note\n" + "".join(f"{i},{'many' if i % 2 else 'few'},n{i}\n" for i in range(80)))
    a, b = (combine.Profiled.of(source.read_delimited(spark, str(tmp_path / f"{n}.csv"))) for n in "ab")
    whole = combine.append(a.table, b.table)
    asked = []
    monkeypatch.setattr(combine, "profiles", lambda df: pytest.fail("rows were read"))
    count = combine.different
    monkeypatch.setattr(combine, "different", lambda df, columns: asked.append(columns) or count(df, columns))
    made = a.append(b)
    for c in ("id", "v", "code", "day", "note"):
        assert kind_of(made.table, c) == kind_of(whole, c), c
    assert asked == []
    assert sorted(map(str, made.table.collect())) == sorted(map(str, whole.collect()))
    more = combine.Profiled(b.table, b.profiles | {"v": replace(b.profiles["v"], most=80)})
    assert kind_of(a.append(more).table, "v") == "category" and asked == [["v"]]  # only then the texts are counted
    again = made.append(a)
    assert kind_of(again.table, "id") == "number" and again.profiles["id"].n == 200
