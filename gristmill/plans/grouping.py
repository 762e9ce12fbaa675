"""Groups, frequencies, pivots and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cleaning, summarize
from ..operators.summarize import Agg
from .registry import query, table

_FNS = {
    "count": "count(*)", "distinct": "count(DISTINCT l_suppkey)", "sum": "round(sum(l_extendedprice), 2)", "mean": "round(avg(l_extendedprice), 6)",
    "median": "median(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "std": "round(stddev_samp(l_extendedprice), 6)",
}


def _group(fn: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        column = None if fn == "count" else "l_suppkey" if fn == "distinct" else "l_extendedprice"
        made = summarize.group(table(spark, sf, "lineitem"), "l_returnflag", [Agg(fn, column)], names=["v"])
        digits = {"sum": 2, "mean": 6, "std": 6}.get(fn)
        return made.withColumn("v", F.round("v", digits)) if digits else made

    return run


for _fn, _sql in _FNS.items():
    query(f"grp_{_fn}", f"SELECT l_returnflag AS key, {_sql} AS v FROM lineitem GROUP BY 1")(_group(_fn))

for _unit, _sql in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y"), ("weekday", "%a")):

    def _dates(unit: str):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            orders = table(spark, sf, "orders")
            made = summarize.group(orders, "o_orderdate", [Agg(), Agg("mean", "o_totalprice")], unit, ["n", "mean_price"])
            return made.withColumn("mean_price", F.round("mean_price", 6))

        return run

    query(f"grp_date_{_unit}", f"SELECT strftime(o_orderdate, '{_sql}') AS key, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY 1")(_dates(_unit))


@query(
    "grp_missing_key",
    "SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '(missing)') AS key, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return summarize.group(events, "event_type", [Agg(), Agg("distinct", "user_id")], names=["n", "users"])


@query("grp_boolean_mean", "SELECT o_orderpriority AS key, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 8) AS share FROM orders GROUP BY 1")
def _share(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("large", F.col("o_totalprice") > 100000)
    return summarize.group(orders, "o_orderpriority", [Agg("mean", "large")], names=["share"]).withColumn("share", F.round("share", 8))


@query(
    "grp_ordered_weekday",
    "SELECT strftime(o_orderdate, '%a') AS key, count(*) AS n, any_value(isodow(o_orderdate)) AS rank FROM orders GROUP BY 1",
)
def _weekdays(spark: SparkSession, sf: str) -> DataFrame:
    made = summarize.group(table(spark, sf, "orders"), "o_orderdate", unit="weekday", names=["n"])
    return summarize.ordered(made, "key", "n", "date", "weekday").withColumn("rank", F.col("rank").cast("long"))


@query("freq_table", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1")
def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.frequencies(table(spark, sf, "part"), "p_type")


@query("freq_suggestions", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), value LIMIT 50")
def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.first_frequencies(table(spark, sf, "part"), "p_brand", 50)


@query(
    "pivot_long_totals",
    "SELECT coalesce(o_orderpriority, '') AS row_key, strftime(o_orderdate, '%Y') AS col_key, round(avg(o_totalprice), 4) AS value, 'cell' AS level FROM orders GROUP BY 1, 2 "
    "UNION ALL SELECT o_orderpriority, NULL, round(avg(o_totalprice), 4), 'row' FROM orders GROUP BY 1 "
    "UNION ALL SELECT NULL, strftime(o_orderdate, '%Y'), round(avg(o_totalprice), 4), 'column' FROM orders GROUP BY strftime(o_orderdate, '%Y') "
    "UNION ALL SELECT NULL, NULL, round(avg(o_totalprice), 4), 'all' FROM orders",
)
def _pivot(spark: SparkSession, sf: str) -> DataFrame:
    made = summarize.pivot(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", Agg("mean", "o_totalprice"), column_unit="year")
    return made.withColumn("value", F.round("value", 4))


@query(
    "pivot_wide",
    "SELECT coalesce(o_orderstatus, 'Total') AS row_key, median(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, "
    "median(o_totalprice) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)",
)
def _wide(spark: SparkSession, sf: str) -> DataFrame:
    made, _ = summarize.pivot_wide(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", Agg("median", "o_totalprice"))
    return made.select("row_key", F.col("`1-URGENT`").alias("urgent"), F.col("Total").alias("total"))


@query("dup_count", "SELECT count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def _repeats(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.count_duplicates(table(spark, sf, "documents").select("text"))


@query(
    "dup_keep_first",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) ORDER BY doc_id) = 1",
)
def _first(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.remove_duplicates(table(spark, sf, "documents"), ["text"], "doc_id").select("doc_id")
