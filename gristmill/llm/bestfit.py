"""Best-fit packing of tokenized documents into training sequences, under several limits at once.

A document is its token ids and an end id. One longer than a sequence is cut into pieces of a sequence's length, of which the
first may be shorter. A sequence has a limit of tokens, of pieces and of attention cost (the sum of squares of its pieces'
lengths). Pieces are placed from the longest to the shortest. Each goes into the open sequence that it fits under every
limit, and among those into the one that scores best: the least weighted norm of what is left after it (``norm``), or the
greatest weighted dot product of its demands and what is left (``dot``).

A piece counts only by its length, so the packing is found for all pieces at once from their histogram, which has
``tokens`` rows at most whatever the corpus: open sequences of equal contents are one group with a number of members,
and a whole range of equal pieces is placed into a whole range of members. The plan (``Placement``) says for each
length which ranks go where; a second pass over the pieces ranks those of a length and looks their place up. The
result is that of placing all pieces of the corpus one by one in one task.

Token ids are those that ``tokenizers`` gives. Texts of Latin letters are read by ``tiktoken`` from the same
vocabulary, whose ids are the same and come four times as fast; all others go through ``tokenizers``.

Edge cases: a null or empty text is a piece of its end id alone; the strings of special tokens are ordinary text; a text
of any length is tokenized whole in its task; pieces of equal length are ranked as they lie in the table, so ties and repeated
rows, null ids too, are pieces of their own; an empty table gives no rows; columns of any other name and type are carried.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import fresh, prefix_sums, saved

MAX_LEN = 2048
END = 0
#: Weights of tokens, pieces and attention cost that are tried; the plan with the fewest sequences is taken.
WEIGHTS = ((1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (1.0, 1.0, 1.0))
#: Characters whose classes are the same to both tokenizers: Latin letters, their punctuation.
_LATIN = re.compile("[\x00-ɏ‐-‧€]*")


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most; by default only tokens count, as the others follow from them."""

    tokens: int = MAX_LEN
    pieces: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        pieces = self.tokens if self.pieces is None else self.pieces
        return np.array([self.tokens, pieces, self.tokens**2 if self.cost is None else self.cost], np.int64)


class Placement(NamedTuple):
    """Pieces of ``length`` from rank ``rank`` on go, ``each`` at a time, into ``members`` sequences from ``first`` on, from
    ``offset`` in each."""

    length: int
    rank: int
    first: int
    members: int
    each: int
    offset: int


def place(histogram: dict[int, int], limits: Limits, weights: Sequence[float] = WEIGHTS[0], rule: str = "norm") -> tuple[int, list[Placement]]:
    """The number of sequences and the placements of all pieces of a histogram (length -> number)."""
    room = limits.vector()
    scaled = np.asarray(weights, float) / room.astype(float) ** 2
    left = np.zeros((0, 3), np.int64)  # what is left in a member of each open group
    first = np.zeros(0, np.int64)
    members = np.zeros(0, np.int64)
    made: list[Placement] = []
    opened = 0
    shortest = min(histogram, default=0)
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length**2], np.int64)
        if (need > room).any():
            raise ValueError(f"a piece of {length} tokens is over the limits")
        rank, count = 0, histogram[length]
        while count:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if not len(fits):
                left, first, members = np.vstack([left, room]), np.append(first, opened), np.append(members, count)
                g, new = len(first) - 1, True
            else:
                rest = left[fits]
                score = ((rest - need) ** 2 * scaled).sum(axis=1) if rule == "norm" else -(rest * need * scaled).sum(axis=1)
                g, new = int(fits[np.argmin(score)]), False
            # by norm a member that took a piece is the best for the next one too; by dot product another is, if there is one
            each = int((left[g] // need).min()) if new or rule == "norm" else 1
            each = min(each, count)
            full = min(int(members[g]), count // each)
            made.append(Placement(length, rank, int(first[g]), full, each, int(room[0] - left[g][0])))
            rank, count = rank + full * each, count - full * each
            more = [(left[g] - each * need, int(first[g]), full)]
            if new:
                opened += full
            elif members[g] > full:
                more.append((left[g], int(first[g]) + full, int(members[g]) - full))
            more = [m for m in more if (m[0] >= (shortest, 1, shortest**2)).all()]
            keep = np.arange(len(first)) != g
            left = np.vstack([left[keep], *[m[0] for m in more]])
            first = np.append(first[keep], [m[1] for m in more]).astype(np.int64)
            members = np.append(members[keep], [m[2] for m in more]).astype(np.int64)
    return opened, made


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> tuple[int, list[Placement]]:
    """The plan with the fewest sequences among those of ``WEIGHTS``."""
    sizes = np.array([[n * c, c, n * n * c] for n, c in histogram.items()], object).reshape(-1, 3).sum(axis=0)
    least = max((-(-int(s) // int(r)) for s, r in zip(sizes, limits.vector(), strict=True)), default=0) if histogram else 0
    best: tuple[int, list[Placement]] | None = None
    for weights in WEIGHTS:
        tried = place(histogram, limits, weights)
        if best is None or tried[0] < best[0]:
            best = tried
        if best[0] == least:
            break
    return best


@functools.lru_cache(maxsize=2)
def _tokenizer(vocabulary: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@functools.lru_cache(maxsize=2)
def _ranks(ranks: str | None):
    import public_tokenizers
    import tiktoken

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})


def ids_of(text: str | None, vocabulary: str | None = None, ranks: str | None = None) -> np.ndarray:
    """The token ids of a text and the end id, as unsigned 32-bit numbers. The files are those of the byte-level
    vocabulary of 50,257 ids unless others are given: one for ``tokenizers``, one with the same ids as ranks."""
    if not text:
        return np.array([END], np.uint32)
    if _LATIN.fullmatch(text):
        found = _ranks(ranks).encode_ordinary(text)
    else:
        found = _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    return np.array([*found, END], np.uint32)


def starts_of(n: int, max_len: int) -> list[int]:
    """Where the pieces of ``n`` ids start."""
    return [0, *range(n % max_len or max_len, n, max_len)]


def tokenized(docs: DataFrame, max_len: int = MAX_LEN, ids: bool = True, text: str = "text", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row per piece: row (all columns of ``docs`` but the text), piece, start, length, ids_crc32 and, if asked for, ids."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    slim = docs.select(rest, F.col(f"`{text}`").alias("text"))
    added = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))
    schema = T.StructType([slim.schema.fields[0], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                found = ids_of(value.as_py(), vocabulary, ranks)
                edges = starts_of(len(found), max_len)
                for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(found)], strict=True)):
                    at.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(found[a:b].astype("<u4").tobytes()))
                    if ids:
                        parts.append(found[a:b].astype(np.int32))
            made = [pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            if ids:
                made.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names=schema.names)

    return slim.mapInArrow(run, schema)


def assigned(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``pieces`` (a written table with piece_id, unique, and length) with sequence_id and offset.

    Ranks among pieces of a length are running counts over parts of the table (the upper bits of piece_id), so no task
    holds all pieces of a length. The plan is broadcast; its size follows from ``limits.tokens``, not from the pieces.
    """
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    placed = plan(histogram, limits)[1]
    table = np.array(sorted(placed, key=lambda p: (p.length, p.rank)), np.int64).reshape(-1, len(Placement._fields))
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    part = F.shiftright("piece_id", 33)
    ranked = prefix_sums(pieces.withColumn("_one", F.lit(1).cast("long")), ["length"], [F.col("piece_id")], part, {"_rank": "_one"}).drop("_one")
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = T.StructType([*kept, *T.StructType.fromDDL("sequence_id long, offset long").fields])
    of = {c: ranked.columns.index(c) for c in ranked.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * (1 << 42) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(of[c]).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            p = rows[np.searchsorted(keys, length * (1 << 42) + rank, "right") - 1]
            turn = rank - p[:, 1]
            sequence, offset = p[:, 2] + turn // p[:, 4], p[:, 5] + turn % p[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(of[f.name]) for f in kept), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, limits: Limits = Limits(), ids: bool = True, text: str = "text", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row per piece: all columns of ``docs`` but the text, and piece, start, length, ids_crc32, ids (if asked for),
    sequence_id, offset (piece_1, ... if there are such columns).

    With a limit of attention cost below the square of ``limits.tokens`` documents are cut shorter, so that a piece alone is
    within it.
    """
    longest = min(limits.tokens, int(limits.vector()[2] ** 0.5))
    pieces = saved(tokenized(docs, longest, ids, text, vocabulary, ranks).withColumn("piece_id", F.monotonically_increasing_id()))
    found = assigned(pieces.select("piece_id", "length") if ids else pieces, limits)
    if ids:
        found = pieces.join(found.drop("length"), "piece_id")
    named = ["piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "sequence_id", "offset"]
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text]
    return found.select(*own, *[F.col(c).alias(fresh(docs, c)) for c in named])


def sequences(pieces: DataFrame) -> DataFrame:
    """A row per sequence of ``packed`` pieces: sequence_id, ids (its tokens in order) and lengths (of its pieces). A
    sequence has ``limits.tokens`` ids at most."""
    run = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(run.alias("run"))
    return grouped.select("sequence_id", F.flatten(F.col("run.ids")).alias("ids"), F.col("run.length").alias("lengths"))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place among the document's ids, their digest, its sequence and place there. The
    limits of pieces and attention cost are those that 2,048 tokens imply, as only tokens are limited here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, ids=False)
