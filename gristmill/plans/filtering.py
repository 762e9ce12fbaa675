"""Filters, search, sorting and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import searching, sorting
from ..operators.filters import Filter, search, where
from ..operators.summarize import Agg, group
from .registry import query, table

_ORDERS = "o_orderkey, o_totalprice"


def _orders(*filters: Filter):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return where(table(spark, sf, "orders"), filters).select("o_orderkey", "o_totalprice")

    return run


for _name, _op, _sql in (("eq", "=", "="), ("ne", "≠", "<>"), ("gt", ">", ">"), ("ge", "≥", ">="), ("lt", "<", "<"), ("le", "≤", "<=")):

    def _make(op: str):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return where(table(spark, sf, "part"), [Filter("p_size", op, "25")]).select("p_partkey", "p_size")

        return run

    query(f"flt_number_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_sql} 25")(_make(_op))

query("flt_number_text_value", f"SELECT {_ORDERS} FROM orders WHERE o_totalprice > 250000")(_orders(Filter("o_totalprice", ">", "$250,000")))
query("flt_date_on", f"SELECT {_ORDERS} FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-05' AND o_orderdate < TIMESTAMP '1996-03-06'")(
    _orders(Filter("o_orderdate", "on", "1996-03-05"))
)
query("flt_date_before", f"SELECT {_ORDERS} FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-05'")(_orders(Filter("o_orderdate", "before", "5 Mar 1996")))
query("flt_date_after", f"SELECT {_ORDERS} FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-02'")(_orders(Filter("o_orderdate", "after", "June 1, 1999")))
query("flt_text_is", f"SELECT {_ORDERS} FROM orders WHERE lower(o_orderstatus) = 'f'")(_orders(Filter("o_orderstatus", "is", " F ")))
query("flt_text_is_not", f"SELECT {_ORDERS} FROM orders WHERE lower(o_orderstatus) <> 'f' OR o_orderstatus IS NULL")(_orders(Filter("o_orderstatus", "is not", "f")))
query("flt_text_contains", f"SELECT {_ORDERS} FROM orders WHERE lower(o_orderpriority) LIKE '%high%'")(_orders(Filter("o_orderpriority", "contains", "HIGH")))
query("flt_text_not_contains", f"SELECT {_ORDERS} FROM orders WHERE lower(o_orderpriority) NOT LIKE '%high%' OR o_orderpriority IS NULL")(
    _orders(Filter("o_orderpriority", "does not contain", "high"))
)
query("flt_conjunction", f"SELECT {_ORDERS} FROM orders WHERE lower(o_orderstatus) = 'o' AND o_totalprice >= 100000 AND o_orderdate < TIMESTAMP '1997-01-01'")(
    _orders(Filter("o_orderstatus", "is", "O"), Filter("o_totalprice", "≥", "100000"), Filter("o_orderdate", "before", "1997-01-01"), Filter("o_totalprice", ">", "abc"), Filter("nothing", "is", "x"))
)

#: Values of events with gaps: errors have none.
GAPS = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events"


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


@query("flt_missing", f"SELECT event_id, event_type FROM ({GAPS}) WHERE value IS NULL")
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    return where(gaps(spark, sf), [Filter("value", "is missing")]).select("event_id", "event_type")


@query("flt_not_missing", f"SELECT event_id, value FROM ({GAPS}) WHERE value IS NOT NULL")
def _not_missing(spark: SparkSession, sf: str) -> DataFrame:
    return where(gaps(spark, sf), [Filter("value", "is not missing")]).select("event_id", "value")


@query("flt_boolean_is", "SELECT p_partkey FROM part WHERE p_size > 25")
def _boolean(spark: SparkSession, sf: str) -> DataFrame:
    return where(table(spark, sf, "part").withColumn("large", F.col("p_size") > 25), [Filter("large", "is", "Yes")]).select("p_partkey")


@query("search_all", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%n_1%' OR CAST(n_nationkey AS VARCHAR) LIKE '%n_1%' OR CAST(n_regionkey AS VARCHAR) LIKE '%n_1%'")
def _search(spark: SparkSession, sf: str) -> DataFrame:
    return search(table(spark, sf, "nation"), "N_1 ").select("n_nationkey", "n_name")


@query("search_indexed", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%blue bolt%' OR lower(p_brand) LIKE '%blue bolt%' OR lower(p_type) LIKE '%blue bolt%'")
def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    return searching.indexed(table(spark, sf, "part"), 16).search(" Blue BOLT").select("p_partkey", "p_name")


@query("sort_nulls_last", f"SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS rank FROM ({GAPS})")
def _sorted(spark: SparkSession, sf: str) -> DataFrame:
    return sorting.ranked(gaps(spark, sf), "value", descending=True, tie="event_id").select("event_id", "value", F.col("rank").cast("long").alias("rank"))


@query("sort_natural", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 997, p_name, p_partkey) AS rank FROM part")
def _natural(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").withColumn("label", F.concat(F.lit("Item "), (F.col("p_partkey") % 997).cast("string"), F.lit(" "), F.col("p_name")))
    return sorting.ranked(named, "label", tie="p_partkey").select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query(
    "top_n_summary",
    "SELECT o_orderpriority AS key, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price "
    "FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 3 DESC LIMIT 12",
)
def _top(spark: SparkSession, sf: str) -> DataFrame:
    held = where(table(spark, sf, "orders"), [Filter("o_orderstatus", "is", "F")])
    grouped = group(held, "o_orderpriority", [Agg(), Agg("mean", "o_totalprice")], names=["n", "mean_price"])
    return sorting.top(grouped.withColumn("mean_price", F.round("mean_price", 4)), "mean_price", 12, tie="key")


@query("page_three", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _page(spark: SparkSession, sf: str) -> DataFrame:
    return sorting.paged(table(spark, sf, "orders"), "o_totalprice", descending=True, tie="o_orderkey").page(2).select("o_orderkey", "o_totalprice")


@query(
    "even_sample",
    "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) "
    "SELECT o_orderkey FROM o WHERE r IN (SELECT CAST(floor(k * n / 500) AS BIGINT) FROM (SELECT unnest(range(500)) AS k), (SELECT count(*) AS n FROM orders))",
)
def _even(spark: SparkSession, sf: str) -> DataFrame:
    return sorting.even_sample(sorting.with_row_numbers(table(spark, sf, "orders"), "o_orderkey"), 500).select("o_orderkey")
