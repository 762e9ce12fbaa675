"""Steps, projects, exports, answers of forms, stored reports and streams over the star schema."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import answers, combine, insights, profile, series, significance
from ..operators.filters import Filter
from ..operators.storage import ensure_checkpoint_dir
from ..sinks import projects, text as sink
from ..sources.text import merged_responses, responses
from ..streaming import live
from .recipe import replay
from .registry import query, table


def fresh_folder(spark: SparkSession, what: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{what}-{uuid.uuid4().hex}")


STEPS = [
    {"op": "rename", "column": "o_totalprice", "name": "price"},
    {"op": "delete", "column": "o_orderdate"},
    {"op": "setType", "column": "o_custkey", "type": "category"},
    {"op": "keepRows", "filters": [{"column": "price", "op": ">", "value": "$100,000"}, {"column": "o_orderstatus", "op": "is not", "value": "p"}]},
]
_KEPT = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice AS price, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'"


@query("steps_replayed", _KEPT)
def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return replay(table(spark, sf, "orders"), STEPS)


@query("project_reopened", _KEPT)
def _project(spark: SparkSession, sf: str) -> DataFrame:
    """A table and its steps, saved and made again from what was saved."""
    path = fresh_folder(spark, "project")
    projects.save_project(table(spark, sf, "orders"), STEPS, path)
    return projects.load_project(spark, path)[1]


@query(
    "export_guarded",
    "SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '-' || p_size WHEN 2 THEN '''@' || p_brand || '\", x' ELSE p_name END AS cell, "
    "CAST(p_size AS VARCHAR) AS size FROM part",
)
def _export(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that a spreadsheet would run are written with an apostrophe, negative numbers are not."""
    at = F.col("p_partkey") % 4
    cell = F.when(at == 0, F.concat(F.lit("="), "p_name")).when(at == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).when(at == 2, F.concat(F.lit("@"), "p_brand", F.lit('", x'))).otherwise(F.col("p_name"))
    path = fresh_folder(spark, "export")
    sink.write_csv(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), cell.alias("cell"), F.col("p_size").alias("size")), path)
    return spark.read.option("header", True).option("escape", '"').schema("key string, cell string, size string").csv(path)


@query(
    "tests_chosen",
    "WITH o AS (SELECT *, hour(o_orderdate) AS h FROM orders), c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), "
    "e AS (SELECT a, b, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x, n FROM c), "
    "g AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS c, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), "
    "w AS (SELECT n_regionkey < 2 AS k, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) "
    "SELECT 'correlation' AS test, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS stat FROM (SELECT corr(p_size, p_retailprice) AS r, count(*)::DOUBLE AS n FROM part) "
    "UNION ALL SELECT 'anova', round((sum(c * m * m) - pow(sum(c * m), 2) / sum(c)) / (count(*) - 1) / (sum((c - 1) * v) / (sum(c) - count(*))), 6) FROM g "
    "UNION ALL SELECT 'chi-square', round(sum((n - x) * (n - x) / x), 6) FROM e "
    "UNION ALL SELECT 'welch', round(abs((max(m) FILTER (k) - max(m) FILTER (NOT k)) / sqrt(sum(v / n))), 6) FROM w",
)
def _tests(spark: SparkSession, sf: str) -> DataFrame:
    """The test that fits the kinds of two columns, for four pairs of kinds."""
    part, orders = table(spark, sf, "part"), table(spark, sf, "orders")
    near = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    near = near.select("c_acctbal", (F.col("n_regionkey") < 2).alias("near"))
    found = [
        ("correlation", significance.test_columns(part, "p_size", "p_retailprice").t), ("anova", significance.test_columns(orders, "o_orderpriority", "o_totalprice").f),
        ("chi-square", significance.test_columns(orders, "o_orderstatus", "o_orderpriority").chi2), ("welch", abs(significance.test_columns(near, "near", "c_acctbal").t)),
    ]
    return spark.createDataFrame(found, "test string, stat double").withColumn("stat", F.round("stat", 6))


@query(
    "join_keys_suggested",
    "WITH a AS (SELECT DISTINCT n_nationkey AS k FROM nation), b AS (SELECT c_nationkey AS k, 'c_nationkey' AS name FROM customer UNION ALL SELECT c_custkey, 'c_custkey' FROM customer), "
    "n AS (SELECT name, count(*) AS rows, count(DISTINCT k) AS keys, count(DISTINCT CASE WHEN k IN (SELECT k FROM a) THEN k END) AS hits FROM b GROUP BY 1) "
    "SELECT 'n_nationkey' AS left_key, name AS right_key, round(hits / keys + CASE WHEN keys > 0.9 * rows THEN 0.25 ELSE 0 END, 6) AS score FROM n WHERE hits > 0",
)
def _keys(spark: SparkSession, sf: str) -> DataFrame:
    left, right = table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    found = combine.suggest_keys(left, right, rows=1 << 30)
    return spark.createDataFrame(found, "left_key string, right_key string, score double").withColumn("score", F.round("score", 6))


@query(
    "kinds_after_appending",
    "SELECT CAST(o_orderkey AS DOUBLE) AS id, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'c' || o_custkey END AS who FROM orders",
)
def _appended(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of texts whose columns are numbers in both, and numbers in one only; their profiles add up."""
    orders = table(spark, sf, "orders")
    texts = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.format_number("o_totalprice", 2).alias("amount"), F.col("o_custkey").cast("string").alias("who"))
    even = combine.Profiled.of(texts.where(F.col("id").cast("long") % 2 == 0))
    odd = combine.Profiled.of(texts.where(F.col("id").cast("long") % 2 == 1).select(F.concat(F.lit("c"), "who").alias(" Who"), F.col("id").alias("ID"), "amount"))
    return even.append(odd).table.select("id", "amount", "who")


@query(
    "form_answers_merged",
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS \"Submitted\", CAST(user_id % 5 + 1 AS DOUBLE) AS \"Rating\", CASE WHEN event_id % 2 = 0 THEN 'tea; milk' ELSE 'tea' END AS \"Drinks\", "
    "event_id % 2 = 0 AS \"Drinks: milk\", CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END AS \"Member\" FROM events",
)
def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that were delivered twice, some of them changed later: each counts once, as it came first."""
    events = table(spark, sf, "events")
    given = F.to_json(F.struct(
        (F.col("user_id") % 5 + 1).alias("r"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("tea"), F.lit("milk"))).otherwise(F.array(F.lit("tea"))).alias("d"),
        F.when(F.col("event_id") % 3 > 0, F.when(F.col("event_id") % 3 == 1, "yes").otherwise("no")).alias("m"),
    ))
    one = events.select(F.col("event_id").alias("id"), F.lit(1).alias("received"), F.date_format("ts", "yyyy-MM-dd").alias("submitted"), given.alias("values"))
    again = one.select("id", F.lit(2).alias("received"), "submitted", F.lit('{"r": 1}').alias("values"))
    fields = [{"id": "r", "label": "Rating", "type": "rating"}, {"id": "d", "label": "Drinks", "type": "checkboxes", "options": ["tea", "milk"]}, {"id": "m", "label": "Member", "type": "yesno"}]
    made = responses(merged_responses([one, again]), fields)
    return made.select(F.col("Submitted").cast("timestamp_ntz").alias("Submitted"), "Rating", "Drinks", "`Drinks: milk`", "Member")


@query(
    "units_of_dates",
    "SELECT 'orders' AS name, CASE WHEN d >= 3 * 365.25 THEN 'year' WHEN d >= 90 THEN 'month' ELSE 'day' END AS period, CASE WHEN d <= 400 THEN 'day' WHEN d <= 3650 THEN 'month' ELSE 'year' END AS line "
    "FROM (SELECT epoch(max(o_orderdate) - min(o_orderdate)) / 86400 AS d FROM orders) UNION ALL "
    "SELECT 'events', CASE WHEN d >= 3 * 365.25 THEN 'year' WHEN d >= 90 THEN 'month' ELSE 'day' END, CASE WHEN d <= 400 THEN 'day' WHEN d <= 3650 THEN 'month' ELSE 'year' END "
    "FROM (SELECT epoch(max(ts) - min(ts)) / 86400 AS d FROM events)",
)
def _units(spark: SparkSession, sf: str) -> DataFrame:
    dated = [(n, table(spark, sf, n), c) for n, c in (("orders", "o_orderdate"), ("events", "ts"))]
    return spark.createDataFrame([(n, series.period_unit(df, c), series.chart_unit(df, c)) for n, df, c in dated], "name string, period string, line string")


@query("spellings_merged", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def _spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings that differ in capitals and blanks become the commonest one."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    spelled = F.when(k % 7 == 0, F.lower(s)).when(k % 11 == 0, F.concat(F.lit("  "), s)).otherwise(s)
    return insights.merge_spellings(table(spark, sf, "customer").select("c_custkey", spelled.alias("segment")), "segment").select("c_custkey", "segment")


@query(
    "report_items",
    "SELECT 'high orders' AS item, NULL AS key, count(*)::DOUBLE AS value FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' "
    "UNION ALL SELECT 'by priority', o_orderpriority, round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2",
)
def _report(spark: SparkSession, sf: str) -> DataFrame:
    """Stored questions asked again under the filters of the table; one names a column that is gone and is left out."""
    specs = [
        {"result": {"kind": "value", "agg": "count"}, "filters": [{"column": "o_totalprice", "op": ">", "value": "200000"}]},
        {"result": {"kind": "summary", "by": "o_orderpriority", "agg": "sum", "column": "o_totalprice"}}, {"result": {"kind": "value", "agg": "sum", "column": "gone"}},
    ]
    found = answers.report(table(spark, sf, "orders"), specs, [Filter("o_orderstatus", "is", "f")])
    assert found[2] == "Missing columns: gone"
    first = found[0].select(F.lit("high orders").alias("item"), F.lit(None).cast("string").alias("key"), F.col("value").cast("double").alias("value"))
    return first.unionByName(found[1].select(F.lit("by priority").alias("item"), "key", F.round("value", 2).alias("value")))


@query("profile_of_labels", "SELECT c_mktsegment AS value, count(*) AS n, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS kinds FROM customer GROUP BY 1")
def _profile(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.profile(table(spark, sf, "customer"), "c_mktsegment")
    return spark.createDataFrame([(v, n, found["distinct"]) for v, n in found["values"]], "value string, n long, kinds long")


@query("stream_groups", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a stream in windows of a day, as they stand when all that has arrived is read."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, made = fresh_folder(spark, "arrived"), fresh_folder(spark, "groups")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    groups = live.live_groups(stream, "event_type", "ts")
    writing = groups.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(made))
    writing.option("checkpointLocation", fresh_folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(made).select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n")
