"""Stored questions, overviews and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.formatting import excel_day, unit_symbol
from ..operators import answers, charts, profile
from .filtering import GAPS, gaps
from .registry import query, table

_FILLED = [{"column": "o_orderstatus", "op": "is", "value": "F"}]


def _ask(result: dict, of: str = "orders", filters: list | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return answers.answer(table(spark, sf, of), {"filters": filters or [], "result": result})

    return run


@query("ask_value", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")
def _value(spark: SparkSession, sf: str) -> DataFrame:
    return _ask({"kind": "value", "agg": "sum", "column": "o_totalprice"}, filters=_FILLED)(spark, sf).select(F.round("value", 2).alias("value"))


query("ask_count", "SELECT count(*) AS value FROM orders WHERE o_totalprice > 100000")(
    _ask({"kind": "value", "agg": "count"}, filters=[{"column": "o_totalprice", "op": ">", "value": "100,000"}])
)


@query("ask_top", "SELECT c_nationkey AS key, round(avg(c_acctbal), 6) AS value FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _top(spark: SparkSession, sf: str) -> DataFrame:
    made = _ask({"kind": "summary", "by": "c_nationkey", "agg": "mean", "column": "c_acctbal", "limit": 5}, "customer")(spark, sf)
    return made.withColumn("value", F.round("value", 6))


@query("ask_by_weekday", "SELECT strftime(o_orderdate, '%a') AS key, max(o_totalprice) AS value, isodow(any_value(o_orderdate)) AS rank FROM orders GROUP BY 1")
def _weekdays(spark: SparkSession, sf: str) -> DataFrame:
    made = _ask({"kind": "summary", "by": "o_orderdate", "unit": "weekday", "agg": "max", "column": "o_totalprice"})(spark, sf)
    return made.withColumn("rank", F.col("rank").cast("long"))


@query("ask_chart", "SELECT o_orderstatus AS label, count(*)::DOUBLE AS value, row_number() OVER (ORDER BY count(*) DESC) AS rank FROM orders GROUP BY 1")
def _chart(spark: SparkSession, sf: str) -> DataFrame:
    return _ask({"kind": "chart", "type": "bar", "x": "o_orderstatus"})(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@query(
    "overview",
    f"SELECT 'event_id' AS column_name, 'number' AS kind, 0 AS missing, count(DISTINCT event_id) AS distinct_values FROM events "
    "UNION ALL SELECT 'ts', 'date', 0, count(DISTINCT ts) FROM events UNION ALL SELECT 'user_id', 'number', 0, count(DISTINCT user_id) FROM events "
    "UNION ALL SELECT 'event_type', 'category', 0, count(DISTINCT event_type) FROM events "
    f"UNION ALL SELECT 'value', 'number', count(*) FILTER (value IS NULL), count(DISTINCT value) FROM ({GAPS})",
)
def _overview(spark: SparkSession, sf: str) -> DataFrame:
    return profile.overview(gaps(spark, sf).drop("props"))


@query("unit_symbols", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '%' END AS unit FROM part")
def _units(spark: SparkSession, sf: str) -> DataFrame:
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit("$"), price)).when(key % 3 == 1, F.concat(price, F.lit("%"))).otherwise(price)
    return table(spark, sf, "part").select("p_partkey", unit_symbol(text).alias("unit"))


@query("excel_days", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders")
def _serials(spark: SparkSession, sf: str) -> DataFrame:
    serial = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000 + 25569
    return table(spark, sf, "orders").select("o_orderkey", excel_day(serial).cast("timestamp_ntz").alias("day"))


@query(
    "ticked_options",
    "SELECT 'view' AS option, count(*) FILTER (event_type = 'view' OR user_id % 2 = 0) AS n FROM events UNION ALL SELECT 'click', count(*) FILTER (event_type = 'click') FROM events UNION ALL SELECT 'never', 0",
)
def _ticked(spark: SparkSession, sf: str) -> DataFrame:
    both = F.when((F.col("user_id") % 2 == 0) & (F.col("event_type") != "view"), F.concat(F.col("event_type"), F.lit("; view"))).otherwise(F.col("event_type"))
    return profile.choices(table(spark, sf, "events").withColumn("picked", both), "picked", ["view", "click", "never"])


@query(
    "chart_stacked_table",
    "SELECT coalesce(CAST(year(o_orderdate) AS VARCHAR), '') AS label, CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS VARCHAR) AS O, "
    "CAST(count(*) FILTER (o_orderstatus = 'P') AS VARCHAR) AS P, CAST(count(*) AS VARCHAR) AS Total FROM orders GROUP BY 1",
)
def _stacked_table(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    return charts.as_table(charts.stacked(orders, "year", "o_orderstatus"), "stacked")


@query(
    "form_field",
    "WITH e AS (SELECT event_id, CASE WHEN user_id % 4 > 0 THEN 1 + user_id % 4 END AS r FROM events) SELECT 'answered' AS what, CAST(count(r) AS DOUBLE) AS n FROM e UNION ALL SELECT 'total', count(*) FROM e UNION ALL SELECT 'mean', round(avg(r), 8) FROM e "
    "UNION ALL SELECT CAST(k AS VARCHAR), count(*) FILTER (r = k) FROM e, (SELECT unnest(range(1, 6)) AS k) GROUP BY k",
)
def _form_field(spark: SparkSession, sf: str) -> DataFrame:
    rating = F.when(F.col("user_id") % 4 > 0, F.to_json(F.struct((1 + F.col("user_id") % 4).alias("r")))).otherwise("{}")
    found = profile.field_summary(table(spark, sf, "events").select(rating.alias("values"), F.col("event_id").alias("received")), {"id": "r", "type": "rating"})
    rows = [("answered", float(found["answered"])), ("total", float(found["total"])), ("mean", round(found["mean"], 8)), *[(o, float(n)) for o, n in found["counts"]]]
    return spark.createDataFrame(rows, "what string, n double")
