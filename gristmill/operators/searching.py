"""Search of all columns that skips blocks of rows by the pieces of text they hold.

A table is written once by blocks, a folder each. For each block a signature has a bit for every run of three
characters that its texts have, in lower case. A search reads only blocks that have all bits of its words; the
texts decide then, so a bit that two runs share costs time and loses nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.values import RAW, text_of
from .filters import search
from .storage import saved

#: Characters of a run, and bits of a signature (in words of 63, which a long holds).
GRAM, WORDS, BITS = 3, 1024, 63


def bits_of(text: str) -> set[int]:
    """The bits of the runs of a text in lower case."""
    raw = text.lower()
    return {zlib.crc32(raw[i : i + GRAM].encode()) % (WORDS * BITS) for i in range(len(raw) - GRAM + 1)}


@dataclass(frozen=True)
class Index:
    """``table`` has the rows with ``_block``; ``signatures`` has (block, word, bits) for the words of a signature that are not 0."""

    table: DataFrame
    signatures: DataFrame

    def blocks(self, query: str) -> list[int] | None:
        """The blocks that may hold the query; None for all, as a query shorter than a run tells nothing."""
        wanted: dict[int, int] = {}
        for b in bits_of(query.strip()):
            wanted[b // BITS] = wanted.get(b // BITS, 0) | 1 << b % BITS
        if not wanted:
            return None
        of = F.create_map(*[F.lit(x) for w, m in wanted.items() for x in (w, m)])[F.col("word")]
        held = self.signatures.where(F.col("word").isin(list(wanted))).where(F.col("bits").bitwiseAND(of) == of)
        return sorted(r["block"] for r in held.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).collect())

    def search(self, query: str) -> DataFrame:
        """The rows that ``filters.search`` finds."""
        found = self.blocks(query)
        held = self.table if found is None else self.table.where(F.col("_block").isin(found))
        return search(held.drop("_block"), query)


def indexed(df: DataFrame, blocks: int | None = None) -> Index:
    """``df`` in blocks (those it is read in, unless a number is given) with their signatures.

    A signature has 64,512 bits; blocks of some ten thousand rows of short texts fill a part of it.
    """
    dealt = df.repartition(blocks) if blocks else df
    table = saved(dealt.withColumn("_block", F.spark_partition_id()), "_block")
    names = [c for c in df.columns if c != RAW]
    texts = table.select("_block", *[F.lower(text_of(table, c)).alias(f"t{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block = batch.column(0).to_numpy()
            for b in np.unique(block):
                rows = batch.filter(pa.array(block == b))
                bits = held.setdefault(int(b), np.zeros(WORDS * BITS, bool))
                for column in rows.columns[1:]:
                    for text in column.drop_null().unique().to_pylist():
                        bits[list(bits_of(text))] = True
        for b, bits in held.items():
            words = bits.reshape(WORDS, BITS) @ (1 << np.arange(BITS, dtype=np.int64))
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int64)), pa.array(at), pa.array(words[at])], names=["block", "word", "bits"])

    marks = texts.mapInArrow(run, "block long, word long, bits long").groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return Index(table, saved(marks))
