"""Tables written as delimited text and read back with the kinds of their columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.storage import ensure_checkpoint_dir
from ..sources.text import load, load_stacked, read_json, typed
from .registry import query, table


def as_text(spark: SparkSession, sf: str) -> str:
    """Orders as delimited text with day-first dates, dollar amounts, yes and no, and notes with quotes and line ends."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("amount"),
        F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no").alias("open"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.concat(F.lit('said "'), F.col("o_orderstatus"), F.lit('",\nthen '), F.col("o_custkey").cast("string")).alias("note"),
    )
    path = os.path.join(ensure_checkpoint_dir(spark), f"text-{uuid.uuid4().hex}")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "load_delimited",
    "SELECT o_orderkey AS id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, round(o_totalprice, 2) AS amount, o_orderstatus = 'O' AS open, "
    "CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS priority, 'said \"' || o_orderstatus || '\",' || chr(10) || 'then ' || o_custkey AS note FROM orders",
)
def _load(spark: SparkSession, sf: str) -> DataFrame:
    found = load(spark, as_text(spark, sf))
    return found.select(F.col("id").cast("long").alias("id"), F.col("day").cast("timestamp_ntz").alias("day"), F.round("amount", 2).alias("amount"), "open", "priority", "note")


@query(
    "column_kinds",
    "SELECT * FROM (VALUES ('id', 'number'), ('day', 'date'), ('amount', 'number'), ('open', 'boolean'), ('priority', 'category'), ('note', 'text')) AS t(column_name, kind) "
    "WHERE column_name <> 'note' UNION ALL SELECT 'note', CASE WHEN count(DISTINCT o_orderstatus || o_custkey) <= greatest(25, 0.5 * count(*)) THEN 'category' ELSE 'text' END FROM orders",
)
def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    found = load(spark, as_text(spark, sf))
    return spark.createDataFrame([(f.name, f.metadata["kind"]) for f in found.schema.fields if "kind" in f.metadata], "column_name string, kind string")


def as_plain_text(spark: SparkSession, sf: str) -> str:
    """Events as text delimited by semicolons, with decimal commas and no line ends within fields, so that files are split."""
    rows = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("seen"),
        F.translate(F.format_number("value", 2), ".,", ",.").alias("value"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("type"),
    )
    path = os.path.join(ensure_checkpoint_dir(spark), f"text-{uuid.uuid4().hex}")
    rows.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def as_array(spark: SparkSession, sf: str) -> str:
    """Customers as JSON arrays, one a file: nested values, brackets and quotes in texts, and a field that only some have."""
    rows = table(spark, sf, "customer").select(
        F.to_json(
            F.struct(
                F.col("c_custkey").alias("key"),
                F.concat(F.lit('[{"'), F.col("c_name"), F.lit('"}, ')).alias("name"),
                F.struct(F.col("c_nationkey").alias("nation"), F.array("c_mktsegment", F.lit("}")).alias("parts")).alias("place"),
                F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("balance"),
            )
        ).alias("value")
    )

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f"{lead if i == 0 else ','}{v}" for i, v in enumerate(batch.column(0).to_pylist())], pa.string())], names=["value"])
            lead = "," if batch.num_rows else lead
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"], pa.string())], names=["value"])

    path = os.path.join(ensure_checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    rows.mapInArrow(bracketed, "value string").write.text(path)
    return path


@query(
    "load_split_text",
    "SELECT event_id AS id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS seen, round(value, 2) AS value, event_type AS type FROM events",
)
def _load_plain(spark: SparkSession, sf: str) -> DataFrame:
    found = load(spark, as_plain_text(spark, sf))
    return found.select(F.col("id").cast("long").alias("id"), F.col("seen").cast("timestamp_ntz").alias("seen"), F.round("value", 2).alias("value"), "type")


@query(
    "load_json_array",
    "SELECT c_custkey AS key, '[{\"' || c_name || '\"},' AS name, '{\"nation\":' || c_nationkey || ',\"parts\":[\"' || c_mktsegment || '\",\"}\"]}' AS place, "
    "CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal, 2) END AS balance FROM customer",
)
def _load_array(spark: SparkSession, sf: str) -> DataFrame:
    found = typed(read_json(spark, as_array(spark, sf)))
    return found.select(F.col("key").cast("long").alias("key"), "name", "place", F.round("balance", 2).alias("balance"))


@query(
    "load_stacked_files",
    "SELECT CAST(o_orderkey AS DOUBLE) AS id, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS part FROM orders",
)
def _load_stacked(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables whose columns differ in order and case, as one that names each row's file."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("amount"))
    home = os.path.join(ensure_checkpoint_dir(spark), f"text-{uuid.uuid4().hex}")
    rows.where("id % 2 = 0").write.option("header", True).csv(f"{home}/even")
    rows.where("id % 2 = 1").select(F.col("amount").alias(" Amount"), F.col("id").alias("ID")).write.option("header", True).csv(f"{home}/odd")
    found = load_stacked(spark, [f"{home}/even", f"{home}/odd"], "part")
    return found.select("id", F.round("amount", 2).alias("amount"), "part")
