"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from ..operators.storage import ensure_checkpoint_dir, saved

__all__ = ["WORD", "bucket_of", "dealt_by", "ensure_checkpoint_dir", "fresh", "map_text", "n_words", "prefix_sums", "saved", "sieved"]

#: Words of 64 bits of a sieve, which is broadcast.
SIEVE = 1 << 20
#: Rows of a bucket of a running sum, about, and buckets that one task sums.
BUCKET, RUN = 512, 4096
#: A word of every contract below: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


#: Types of the columns that ``map_text`` can add.
ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<struct<start:long,length:long,period:long>>": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
}


def map_text(df: DataFrame, text: str, work: Callable[[list[str | None]], dict[str, Any]], added: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns ``added`` (name -> type) that ``work`` makes from a batch of texts (or other values).

    All other columns pass through as Arrow arrays, whatever their types and nulls; columns of the added names are
    replaced and those in ``drop`` left out.
    """
    kept = [f for f in df.schema.fields if f.name not in added and f.name not in drop]
    schema = T.StructType([*kept, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in added.items())).fields])
    at, names = [i for i, f in enumerate(df.schema.fields) if f in kept], schema.names
    of = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch.column(of).to_pylist())
            new = [pa.array(made[n], ARROW[t]) for n, t in added.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *new], names=names)

    return df.mapInArrow(run, schema)


def sieved(df: DataFrame, ids: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: false only where no row of ``ids`` has that ``key`` (a long expression
    over columns that both have).

    A row falls on one of ``SIEVE`` x 64 bits; at most ``SIEVE`` words of bits are broadcast, however many ids there are.
    The more ids, the more rows stay true that are not among them, so an exact join follows; it has fewer rows to shuffle.
    """
    h = F.xxhash64(key)
    word, bit = h.bitwiseAND(F.lit(SIEVE - 1)), F.shiftrightunsigned(h, 58).cast("int")
    at, word_at, bits = fresh(df, "sieve_at"), fresh(df, "sieve_word"), fresh(df, "sieve_bits")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = ids.select(word.alias(word_at), bit.alias("bit")).groupBy(word_at).agg(F.bit_or(one).alias(bits))
    found = df.withColumn(at, word).join(F.broadcast(words), F.col(at) == F.col(word_at), "left")
    has = F.coalesce(F.call_function("getbit", F.col(bits), bit) == 1, F.lit(False))
    return found.withColumn(name, has).drop(at, word_at, bits)


def n_words(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def dealt_by(key: Column, row: Column) -> Column:
    """A digest of a key (text), and of ``row`` where the key is null, so that rows without a key do not stay together."""
    return F.md5(F.coalesce(key, F.concat(F.lit("row "), row.cast("string"))))


def bucket_of(digest: Column, rows: int) -> Column:
    """A bucket (long) by the first hexadecimal digits of a digest, for about ``BUCKET`` of ``rows`` rows each, that the
    digest's order follows."""
    digits = max(1, min(7, math.ceil(math.log(max(rows / BUCKET, 1), 16))))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def prefix_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column, values: dict[str, str]
) -> DataFrame:
    """Exclusive running sums within ``group`` in the order (bucket, *order), with no task holding a whole group.

    ``bucket`` is a long expression that the leading order follows. Rows of one (group, bucket) meet in one task;
    only a row for each ``RUN`` buckets is summed over a whole group. ``values`` maps new columns to summed columns.
    """
    group = F.concat_ws("", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{g}`").cast("string")), F.lit("-")) for g in group])
    keyed = df.withColumns({"_group": group, "_bucket": bucket})
    keys = ["_group", "_bucket"]
    sums = keyed.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    # buckets are summed ``RUN`` at a time and then the runs, so no task holds all buckets of a group
    sums = sums.withColumn("_run", F.floor(F.col("_bucket") / RUN))
    runs = sums.groupBy("_group", "_run").agg(*[F.sum(f"_sum_{k}").alias(f"_run_{k}") for k in values])
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_group", "_run", *[before(W.partitionBy("_group").orderBy("_run"), f"_run_{k}").alias(f"_run_{k}") for k in values])
    within = W.partitionBy("_group", "_run").orderBy("_bucket")
    base = sums.select(*keys, "_run", *[before(within, f"_sum_{k}").alias(f"_sum_{k}") for k in values]).join(runs, ["_group", "_run"])
    base = base.select(*keys, *[(F.col(f"_sum_{k}") + F.col(f"_run_{k}")).alias(f"_base_{k}") for k in values])
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for k, v in values.items()})
    # the join has the keys of the window, so the rows are not dealt again
    out = local.join(base, keys).withColumns({k: F.col(f"_in_{k}") + F.col(f"_base_{k}") for k in values})
    return out.drop(*[c for c in out.columns if c.startswith(("_base_", "_in_"))], *keys)
