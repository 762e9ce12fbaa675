"""Packing documents into batches of near-equal length.

Documents longer than ``max_len`` words are cut into pieces. The histogram of piece lengths has at most ``max_len`` + 1
rows whatever the corpus, so the driver may hold it: dynamic programming over it finds the bucket boundaries with the
least padding. Inside a bucket, pieces in a fixed pseudo-random order fill batches of a token budget.

Edge cases: null or empty text is one piece of 0 words in the shortest bucket; repeated rows and rows of null id are
rows of their own; an empty table gives no rows; other columns may have any type and name, as ``packed`` carries them in
one column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import BUCKET, bucket_of, dealt_by, fresh, n_words, prefix_sums, saved

MAX_LEN = 2048
BUCKETS = 16
BATCH_TOKENS = 65536


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding (exact)."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    n, k = len(lengths), min(buckets, len(lengths))
    c = np.concatenate([[0.0], np.cumsum(counts)])
    s = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice = np.zeros((k + 1, n + 1), dtype=np.int64)
    for b in range(1, k + 1):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            new[j], choice[b, j] = cost[i], i
        best = new
    found, j = [], n
    for b in range(k, 0, -1):
        found.append(int(lengths[j - 1]))
        j = int(choice[b, j])
    return found[::-1]


def lengths_of_pieces(sized: DataFrame, tokens: str, max_len: int) -> DataFrame:
    """A row per piece: pack_piece (from 0) and pack_tokens; every row has one piece at least."""
    last = F.greatest(F.ceil(F.col(tokens) / max_len).cast("int") - 1, F.lit(0))
    rows = sized.withColumn("pack_piece", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("pack_tokens", F.least(F.lit(max_len), F.col(tokens) - F.col("pack_piece") * max_len).cast("long"))


def pack(
    pieces: DataFrame, key: str, row: str | None = None, *, place: str | None = None, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS
) -> DataFrame:
    """``pieces`` (with pack_piece and pack_tokens) with pack_bucket (padded length), pack_batch (number of the batch
    in its bucket) and pack_slot (place in the batch).

    Batches of a bucket fill in the order of ``place`` (a number) if it is given, else in a fixed pseudo-random order of the
    key, with ``row`` for null keys.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("pack_tokens").count().collect()}
    bounds = best_boundaries(histogram, buckets) or [0]
    at = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        at = F.when(F.col("pack_tokens") <= b, F.lit(b)).otherwise(at)
    spelled = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("pack_piece").cast("string"))
    digest = F.md5(spelled) if row is None else dealt_by(F.when(F.col(key).isNotNull(), spelled), F.concat_ws(":", F.col(row), "pack_piece"))
    order, bucket = [digest, F.col(key).asc_nulls_first(), F.col("pack_tokens")], bucket_of(digest, sum(histogram.values()))
    if place:
        order, bucket = [F.col(place), F.col("pack_piece"), *order], F.floor(F.col(place) / BUCKET)
    numbered = prefix_sums(
        pieces.withColumns({"pack_bucket": at.cast("long"), "_one": F.lit(1).cast("long")}),
        ["pack_bucket"],
        order,
        bucket,
        {"_number": "_one"},
    )
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("pack_bucket"), F.lit(1)))).cast("long")
    out = numbered.withColumns(
        {"pack_batch": F.floor(F.col("_number") / room).cast("long"), "pack_slot": (F.col("_number") % room).cast("long")}
    )
    return out.drop("_number", "_one")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: str | None, max_len: int) -> list[str]:
    """The pieces of a text; joined they are the text again. A piece starts at a word, the first at the text's start."""
    if text is None:
        return [""]
    raw = text.encode()
    if len(raw) <= 2 * max_len:
        return [text]
    starts = [m.start() for i, m in enumerate(_WORD.finditer(raw)) if i % max_len == 0]
    edges = [0, *starts[1:], len(raw)]
    return [raw[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)]


def lies_at(docs: DataFrame) -> Column:
    """A number that rises with the order in which a table was written: by the numbers of its files and the places of rows in
    them. For tables that are not read from files it is the order in which they come."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    name = F.col("_metadata.file_name")
    digits = lambda p: F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0).cast("long"))
    return (digits(r"part-(\d+)") * 1024 + digits(r"-c(\d+)")) * F.lit(1 << 32) + F.col("_metadata.row_index")


def cut_pieces(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """A row per piece: row (a struct of all columns of ``docs`` but the text), text, pack_place (of its document in the
    table), pack_piece and pack_tokens."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    slim = docs.select(rest, "text", lies_at(docs).alias("pack_place"))
    schema = T.StructType([*slim.schema.fields, T.StructField("pack_piece", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [cut(t, max_len) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            text = pa.array([x for p in parts for x in p], pa.string())
            piece = pa.array([i for p in parts for i in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), text, batch.column(2).take(pa.array(at)), piece], names=schema.names)

    return slim.mapInArrow(run, schema).withColumn("pack_tokens", n_words(F.col("text")))


def packed(docs: DataFrame, key: str = "doc_id", max_len: int = MAX_LEN, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The pieces of ``docs`` with all its columns, and piece, n_tokens, bucket, batch and slot (with a number behind
    them if ``docs`` has a column of that name). Batches of a bucket follow the order of the table, so that of a curriculum
    stays, and copies of a document are as far from each other as they are in it."""
    pieces = saved(cut_pieces(docs, max_len)).withColumn("pack_key", F.col(f"row.`{key}`"))
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    named = {"piece": "pack_piece", "n_tokens": "pack_tokens", "bucket": "pack_bucket", "batch": "pack_batch", "slot": "pack_slot"}
    found = pack(pieces, "pack_key", place="pack_place", batch_tokens=batch_tokens)
    return found.select(*own, *[F.col(c).alias(fresh(docs, n)) for n, c in named.items()])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bucket (padded length), batch, slot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = saved(docs.select("doc_id", n_words(F.col("text")).alias("n"), F.monotonically_increasing_id().alias("pack_row")))
    packed = pack(lengths_of_pieces(sized, "n", MAX_LEN), "doc_id", "pack_row")
    return packed.select(
        "doc_id",
        F.col("pack_piece").alias("piece"),
        F.col("pack_tokens").alias("n_tokens"),
        F.col("pack_bucket").alias("bucket"),
        F.col("pack_batch").alias("batch"),
        F.col("pack_slot").alias("slot"),
    )


OP8_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
cut AS (SELECT doc_id, n, unnest(range(0, greatest((n + {MAX_LEN - 1}) // {MAX_LEN}, 1))) AS piece FROM sized),
pieces AS (SELECT doc_id, piece, least({MAX_LEN}, n - piece * {MAX_LEN}) AS n_tokens FROM cut),
histogram AS (SELECT n_tokens AS width, count(*) AS c FROM pieces GROUP BY 1),
lengths AS (
  SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS width, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS s UNION ALL
  SELECT row_number() OVER (ORDER BY width), width, CAST(sum(c) OVER (ORDER BY width) AS BIGINT), CAST(sum(c * width) OVER (ORDER BY width) AS BIGINT) FROM histogram),
best AS (
  SELECT CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, {{'cost': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT)}} AS x
  UNION ALL
  SELECT d.b + 1, u.j, min({{'cost': d.x.cost + u.width * (u.c - l.c) - (u.s - l.s), 'i': d.j}})
  FROM best d JOIN lengths l ON l.j = d.j JOIN lengths u ON u.j > d.j WHERE d.b < {BUCKETS} GROUP BY d.b, u.j),
back AS (
  SELECT b, j, x.i AS i FROM best WHERE b = (SELECT least({BUCKETS}, max(j)) FROM lengths) AND j = (SELECT max(j) FROM lengths)
  UNION ALL SELECT p.b, p.j, p.x.i FROM back JOIN best p ON p.b = back.b - 1 AND p.j = back.i WHERE back.b > 1),
bounds AS (SELECT width AS bucket, coalesce(lag(width) OVER (ORDER BY width), -1) AS above FROM back JOIN lengths USING (j)),
placed AS (
  SELECT doc_id, piece, n_tokens, bucket, greatest(1, {BATCH_TOKENS} // greatest(bucket, 1)) AS room, row_number() OVER (
    PARTITION BY bucket ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || piece), doc_id NULLS FIRST, n_tokens) - 1 AS place
  FROM pieces JOIN bounds ON n_tokens > above AND n_tokens <= bucket)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, n_tokens, bucket, place // room AS batch, place % room AS slot FROM placed
"""
