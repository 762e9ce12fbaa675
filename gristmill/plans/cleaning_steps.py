"""Cleaning steps, joins and stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import is_missing, parse_boolean, parse_date, parse_number
from ..operators import cleaning, combine
from ..operators.sorting import with_row_numbers
from ..operators.summarize import Agg, group
from ..plans.recipe import replay
from .filtering import GAPS, gaps
from .registry import query, table

for _how, _fn in (("mean", "avg"), ("median", "median")):

    def _filled(how: str):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return cleaning.fill(gaps(spark, sf), "value", how).select("event_id", F.round("value", 6).alias("value"))

        return run

    query(f"fill_{_how}", f"SELECT event_id, round(coalesce(value, (SELECT {_fn}(value) FROM ({GAPS}))), 6) AS value FROM ({GAPS})")(_filled(_how))


@query("fill_value", f"SELECT event_id, coalesce(value, 12.5) AS value FROM ({GAPS})")
def _value(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.fill(gaps(spark, sf), "value", "value", "12.5").select("event_id", "value")


@query(
    "fill_mode",
    "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type FROM events), "
    "m AS (SELECT event_type AS v FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT event_id, coalesce(event_type, v) AS event_type FROM e, m",
)
def _mode(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return cleaning.fill(events, "event_type", "mode").select("event_id", "event_type")


@query("fill_previous", f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ({GAPS})")
def _previous(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.fill_previous(gaps(spark, sf), "value", "event_id").select("event_id", "value")


@query("drop_missing", f"SELECT event_id, value FROM ({GAPS}) WHERE value IS NOT NULL")
def _dropped(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_missing(gaps(spark, sf), "value").select("event_id", "value")


def _text(how: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        part = table(spark, sf, "part").withColumn("p_type", F.concat(F.lit("  "), F.col("p_type"), F.lit("\t x "), F.col("p_name")))
        return cleaning.change_text(part, "p_type", how).select("p_partkey", "p_type")

    return run


_T = "'  ' || p_type || chr(9) || ' x ' || p_name"
query("text_trim", f"SELECT p_partkey, trim(regexp_replace({_T}, '\\s+', ' ', 'g')) AS p_type FROM part")(_text("trim"))
query("text_lower", f"SELECT p_partkey, lower({_T}) AS p_type FROM part")(_text("lower"))
query("text_upper", f"SELECT p_partkey, upper({_T}) AS p_type FROM part")(_text("upper"))
query(
    "text_title",
    f"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower({_T}), '([\\s\\-_/]+|[^\\s\\-_/]+)'), lambda x: upper(x[1]) || x[2:]), '') AS p_type FROM part",
)(_text("title"))


@query("replace_contains", "SELECT p_partkey, replace(p_brand, '#', '$1\\') AS p_brand FROM part")
def _replaced(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.replace(table(spark, sf, "part"), "p_brand", "#", "$1\\").select("p_partkey", "p_brand")


@query("replace_whole", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Filled' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _whole(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.replace(table(spark, sf, "orders"), "o_orderstatus", "f", "Filled", whole=True).select("o_orderkey", "o_orderstatus")


@query("standardize", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _standard(spark: SparkSession, sf: str) -> DataFrame:
    names = {"BUILDING": "Building", "MACHINERY": "Machines"}
    return cleaning.standardize(table(spark, sf, "customer"), "c_mktsegment", names).select("c_custkey", "c_mktsegment")


@query("split", 'SELECT p_partkey, split_part(p_brand, \'#\', 1) AS "p_brand 1", split_part(p_brand, \'#\', 2) AS "p_brand 2" FROM part')
def _split(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.split(table(spark, sf, "part"), "p_brand", "#").select("p_partkey", "p_brand 1", "p_brand 2")


@query("bins", "SELECT p_partkey, CAST(CAST(floor(p_size / 10.0 + 1e-9) * 10 AS INT) AS VARCHAR) || ' – ' || CAST(CAST(floor(p_size / 10.0 + 1e-9) * 10 + 10 AS INT) AS VARCHAR) AS size_range FROM part")
def _bins(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.group_ranges(table(spark, sf, "part"), "p_size", "size_range", 10).select("p_partkey", "size_range")


@query(
    "top_other",
    "WITH t AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5) "
    "SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT * FROM t) THEN CAST(c_nationkey AS VARCHAR) ELSE 'Other' END AS nation FROM customer",
)
def _top(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return cleaning.group_top(customer, "c_nationkey", "nation", 5).select("c_custkey", "nation")


@query(
    "date_parts",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS year, 'Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%b') AS month, "
    "strftime(o_orderdate, '%Y-%m') AS \"yearMonth\", strftime(o_orderdate, '%a') AS weekday, CAST(day(o_orderdate) AS DOUBLE) AS day FROM orders",
)
def _parts(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    for part in cleaning.DATE_PARTS:
        df = cleaning.date_part(df, "o_orderdate", part, part)
    return df.select("o_orderkey", *cleaning.DATE_PARTS)


@query(
    "unpivot",
    "SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) "
    "UNPIVOT INCLUDE NULLS (value FOR measure IN (l_quantity, l_discount, l_tax))",
)
def _long(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return cleaning.unpivot(held, ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@query(
    "widen",
    "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS \"F\", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS \"O\", "
    "round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS \"P\" FROM orders GROUP BY 1",
)
def _wide(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    made = cleaning.widen(held, "o_orderstatus", "o_totalprice")
    return made.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in ("F", "O", "P")])


@query(
    "parse_values",
    "SELECT * FROM (VALUES (' 1,234.5 ', 1234.5, NULL, NULL), ('$20', 20, NULL, NULL), ('45%', 45, NULL, NULL), ('(1,234)', -1234, NULL, NULL), ('1e3', 1000, NULL, NULL), "
    "('n/a', NULL, NULL, NULL), ('Yes', NULL, NULL, true), ('2024-03-05', NULL, TIMESTAMP '2024-03-05', NULL), ('31/12/2023', NULL, TIMESTAMP '2023-12-31', NULL), "
    "('Sept 3, 2021', NULL, TIMESTAMP '2021-09-03', NULL), ('3 January 2021', NULL, TIMESTAMP '2021-01-03', NULL), ('2023-02-31', NULL, NULL, NULL), "
    "('2023-01-01T00:30+02:00', NULL, TIMESTAMP '2022-12-31 22:30:00', NULL), ('12,34', NULL, NULL, NULL)) AS t(text, number, date, flag)",
)
def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    texts = [" 1,234.5 ", "$20", "45%", "(1,234)", "1e3", "n/a", "Yes", "2024-03-05", "31/12/2023", "Sept 3, 2021", "3 January 2021", "2023-02-31", "2023-01-01T00:30+02:00", "12,34"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    c, ok = F.col("text"), ~is_missing(F.col("text"))
    return df.select("text", F.when(ok, parse_number(c)).alias("number"), F.when(ok, parse_date(c)).cast("timestamp_ntz").alias("date"), F.when(ok, parse_boolean(c)).alias("flag"))


@query(
    "recipe_replay",
    "SELECT priority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM (SELECT split_part(o_orderpriority, '-', 2) AS priority, o_totalprice FROM orders "
    "WHERE o_totalprice > 50000 AND lower(o_orderstatus) = 'o') GROUP BY 1",
)
def _recipe(spark: SparkSession, sf: str) -> DataFrame:
    steps = [
        {"op": "keepRows", "filters": [{"column": "o_totalprice", "op": ">", "value": "50000"}, {"column": "o_orderstatus", "op": "is", "value": "O"}]},
        {"op": "split", "column": "o_orderpriority", "by": "-"},
        {"op": "rename", "column": "o_orderpriority 2", "name": "priority"},
        {"op": "delete", "column": "o_orderpriority 1"},
    ]
    made = group(replay(table(spark, sf, "orders"), steps), "priority", [Agg("sum", "o_totalprice"), Agg()], names=["total", "n"])
    return made.select(F.col("key").alias("priority"), F.round("total", 2).alias("total"), "n")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _left(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@query("join_inner", "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _inner(spark: SparkSession, sf: str) -> DataFrame:
    first = combine.join(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "inner")
    return combine.join(first, table(spark, sf, "nation"), "c_nationkey", "n_nationkey", "inner").select("o_orderkey", "n_name")


@query(
    "join_full",
    "SELECT coalesce(c_custkey, o_custkey) AS c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) FULL JOIN (SELECT * FROM orders WHERE o_custkey % 2 = 0) ON c_custkey = o_custkey",
)
def _full(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "customer").where("c_custkey % 3 = 0"), table(spark, sf, "orders").where("o_custkey % 2 = 0")
    return combine.join(a, b, "c_custkey", "o_custkey", "full").select("c_custkey", "o_orderkey")


@query("join_text_key", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def _spelled(spark: SparkSession, sf: str) -> DataFrame:
    spelled = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" 00"), F.col("o_custkey").cast("string"), F.lit(".0 ")).alias("customer"))
    return combine.join(table(spark, sf, "customer"), spelled, "c_custkey", "customer", "inner").select("c_custkey", "o_orderkey")


@query(
    "join_preview",
    "WITH a AS (SELECT c_custkey AS k, count(*) AS a FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), b AS (SELECT o_custkey AS j, count(*) AS b FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), "
    "f AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON k = j) "
    "SELECT CAST(sum(a) AS BIGINT) AS left_rows, CAST(sum(CASE WHEN b > 0 THEN a ELSE 0 END) AS BIGINT) AS matched_left, CAST(sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS unmatched_right, "
    "count(*) FILTER (a > 0 AND b > 1) AS duplicate_keys, CAST(sum(a * b) AS BIGINT) AS inner_rows, CAST(sum(CASE WHEN b > 0 THEN a * b ELSE a END) AS BIGINT) AS left_result_rows, "
    "CAST(sum(CASE WHEN a > 0 AND b > 0 THEN a * b ELSE a + b END) AS BIGINT) AS full_rows FROM f",
)
def _preview(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "customer").where("c_custkey % 3 = 0"), table(spark, sf, "orders").where("o_custkey % 2 = 0")
    return combine.preview(a, b, "c_custkey", "o_custkey")


@query(
    "append_source",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS source FROM customer "
    "UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'suppliers' FROM supplier",
)
def _append(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("Balance"), F.col("s_suppkey").alias("ID"), F.col("s_name").alias(" Name"))
    return combine.append(a, b, "source", "customers", "suppliers")


@query("row_numbers", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS _rid FROM events")
def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    return with_row_numbers(table(spark, sf, "events"), "event_id").select("event_id", "_rid")
