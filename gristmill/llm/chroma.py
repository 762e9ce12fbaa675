"""Audio fingerprints from pitch-class frames, and the alignment of recordings with them.

A recording is mono PCM. Overlapping frames are folded by their spectrum into 12 pitch classes. Over the integral image
of these frames, 16 filters (differences of rectangle sums) are each cut at three thresholds into 2 bits in Gray code,
which pack into one 32-bit integer for each place in time.

Alignment: the differences in time of equal integers of two recordings form an offset histogram; at its mode the share
of differing bits over the overlap says whether they match. Queries are all recordings whose id divides by 20; they are
searched against all recordings. Recordings of one fingerprint are one class. The index files each class under all its
integers, and classes that share one with a query are compared, each pair only under the least one that they share. No
match is lost, as its votes are equal integers. Large keys are dealt to a grid of blocks of recordings and queries, so no
task holds a whole one, and what leaves a task is a row per recording, never all pairs.

The test tables have no audio: ``sonified`` plays a vector as a melody, a tone per component.

The integers of a recording are shuffled with each of its keys, so a recording of n different integers moves about n² numbers.

Edge cases: null, empty and too short recordings have no integers, class and match; nulls in a vector are silence;
repeated rows are classed together, rows of null id ask for nothing, and a query matches itself at offset 0; an empty table gives no rows; ties go to the lower
error, then the lower id; recordings of an hour and more are aligned in memory of their own length, silence too; other columns
than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_text, saved

RATE, FRAME, HOP = 5512, 1024, 512
LOWEST, HIGHEST = 150.0, 2200.0
SPAN = 8  # frames that the widest filter covers
#: Equal integers at the best offset, and share of differing bits at most, for a match.
VOTES, ERROR = 3, 0.25
#: Recordings and queries of a block.
BLOCK = 1024

#: (kind, first pitch class, pitch classes, frames); kind: how the rectangle is split into plus and minus.
FILTERS = tuple(
    (("pitch", "time", "cross", "middle")[i % 4], (5 * i) % 12, (3, 4, 6, 8)[i // 4], (2, 4, 6, 8)[(i + i // 4) % 4]) for i in range(16)
)
THRESHOLDS = (-0.08, 0.0, 0.08)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def _pitch_classes() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hz), 12))
    use = (hz >= LOWEST) & (hz <= HIGHEST)
    note = 12 * np.log2(hz[use] / 440.0) + 9
    low = np.floor(note).astype(int)
    rows = np.flatnonzero(use)
    np.add.at(fold, (rows, low % 12), 1 - (note - low))
    np.add.at(fold, (rows, (low + 1) % 12), note - low)
    return fold


_FOLD, _WINDOW = _pitch_classes(), np.hanning(FRAME)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames x 12, each frame of unit length (silent frames are zero)."""
    n = (len(pcm) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[::HOP]
    out = (np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2) @ _FOLD
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def codes(frames: np.ndarray) -> np.ndarray:
    """Packed integers (uint32), one for each place where all filters fit."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    wide = np.concatenate([frames, frames], axis=1)  # pitch classes go round
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)

    def area(t: int, dt: int, p: int, dp: int) -> np.ndarray:
        a, b = image[t : t + n], image[t + dt : t + dt + n]
        return b[:, p + dp] - b[:, p] - a[:, p + dp] + a[:, p]

    out = np.zeros(n, dtype=np.uint32)
    for kind, p, dp, dt in FILTERS:
        whole, h, w = area(0, dt, p, dp), dp // 2, dt // 2
        if kind == "pitch":
            plus = area(0, dt, p, h)
        elif kind == "time":
            plus = area(0, w, p, dp)
        elif kind == "cross":
            plus = area(0, w, p, h) + area(w, dt - w, p + h, dp - h)
        else:
            plus = area(0, dt, p + dp // 3, dp - 2 * (dp // 3))
        level = np.digitize((2 * plus - whole) / dt, THRESHOLDS)
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def sonified(vector: np.ndarray) -> np.ndarray:
    """PCM (16 bit) of a melody: each component in turn sets the pitch of a short tone."""
    v = np.asarray(vector, dtype=np.float64)
    if not len(v):
        return np.zeros(0, dtype=np.int16)
    step = np.clip(np.rint(v / 0.125 * 6) + 12, 0, 24)
    t = np.arange(HOP) / RATE
    tones = np.sin(2 * np.pi * (220.0 * 2 ** (step / 12))[:, None] * t)
    return (tones.ravel() * 12000).astype(np.int16)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one integer as (integer, place, length), by integer."""
    begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    length = np.diff(np.append(begin, len(codes)))
    order = np.argsort(codes[begin], kind="stable")
    return codes[begin][order], begin[order], length[order]


def offsets(a: np.ndarray, b: np.ndarray, pairs: int = 1 << 20) -> np.ndarray:
    """Offset histogram: how many equal integers of ``a`` and ``b`` are each distance apart, from -len(a) on.

    Stretches of one integer (silence, a held tone) are taken whole: two of them give a trapezoid, which is four changes of
    slope. So an hour of silence is one pair of stretches, and never more than ``pairs`` are held at once.
    """
    slopes = np.zeros(len(a) + len(b) + 4, dtype=np.int64)
    if not len(a) or not len(b):
        return slopes
    (x, i, m), (y, j, n) = _runs(a), _runs(b)
    low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(x):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + pairs, "right")))
        many = (high - low)[start:stop]
        left = np.repeat(np.arange(start, stop), many)
        right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[start:stop], many)
        first = j[right] - i[left] - m[left] + 1 + len(a)
        for at, change in ((first, 1), (first + m[left], -1), (first + n[right], -1), (first + m[left] + n[right], 1)):
            slopes += change * np.bincount(at, minlength=len(slopes))
        start = stop
    return slopes.cumsum().cumsum()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Mode of the offset histogram (place in b less place in a), its votes, and the share of differing bits there."""
    votes = offsets(a, b)
    if not votes.any():
        return 0, 0, 1.0
    at = int(votes.argmax()) - len(a)
    x, y = (a, b[at:]) if at >= 0 else (a[-at:], b)
    n = min(len(x), len(y))
    wrong = int(np.bitwise_count(x[:n] ^ y[:n]).sum())
    return at, int(votes.max()), wrong / (32 * n)


def with_fingerprints(recordings: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, codes, digest): packed integers as an array of ints, and their hash."""

    def work(vectors: list[list[float] | None]) -> dict[str, list[np.ndarray]]:
        return {"codes": [codes(chroma(sonified([x or 0.0 for x in v or ()]))).view(np.int32) for v in vectors]}

    made = map_text(recordings.select(key, vector), vector, work, {"codes": "array<int>"}, drop=[vector])
    return made.withColumn("digest", F.xxhash64("codes"))


def search(prints: DataFrame, key: str) -> DataFrame:
    """(digest, class_id, n_queries, query, at, error): for each class the number of query classes that match it and the
    best of them, with its offset and error."""
    query = F.max(F.coalesce(F.col(key) % 20 == 0, F.lit(False)))
    whole = prints.where(F.size("codes") > 1).groupBy("digest").agg(F.min(key).alias("class_id"), query.alias("asks"), F.first("codes").alias("codes"))

    classes = saved(whole)
    filed = classes.select("digest", "asks", F.array_min("codes").alias("least"), F.explode(F.array_distinct("codes")).alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).where("q > 0")
    # a key of one class brings no pair but that of the class and itself, which the least key brings
    needed = filed.join(sizes, "key").where("n > 1 or key = least").drop("asks", "least")
    grid = needed.join(classes.drop("asks").withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    row = F.pmod(F.xxhash64("digest", F.lit(1)), blocks("n")).cast("int")
    recordings = grid.select("key", row.alias("r"), F.explode(F.sequence(F.lit(0), blocks("q") - 1)).alias("s"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("class_id"), "codes", "digest")
    column = F.pmod(F.xxhash64("digest", F.lit(2)), blocks("q")).cast("int")
    asked = (
        grid.join(classes.where("asks").select(F.col("digest").alias("e")), F.col("digest") == F.col("e"), "left_semi")
        .select("key", F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("r"), column.alias("s"), F.lit(True).alias("asks"), F.coalesce("class_id", F.lit(0)).alias("class_id"), "codes", "digest")
    )

    names = ["digest", "n", "error", "query", "at"]

    def compare(key: int, rows: list[tuple[bool, int, np.ndarray, int]]) -> list[tuple]:
        """Matches of the rows (asks, class_id, codes, digest) of a block of ``key``."""
        code = [x[2].view(np.uint32) for x in rows]
        less = [set(x[2][x[2] < key].tolist()) for x in rows]
        asks, out = [i for i, x in enumerate(rows) if x[0]], []
        for r, (asking, _, _, digest) in enumerate(rows):
            if asking:
                continue
            best, n = (2.0, 0, 0), 0
            for q in asks:
                if not less[r].isdisjoint(less[q]):
                    continue
                at, votes, error = align(code[q], code[r])
                if votes >= VOTES and error <= ERROR:
                    n += 1
                    best = min(best, (error, rows[q][1], at))
            if n:
                out.append((digest, n, *best))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, []
        for pdf in batches:
            found = []
            for key, r, s, asking, class_id, code, digest in pdf.itertuples(index=False, name=None):
                if (key, r, s) != here:
                    found += compare(here[0], held) if held else []
                    here, held = (key, r, s), []
                held.append((asking, class_id, np.asarray(code, dtype=np.int32), digest))
            yield pd.DataFrame(found, columns=names)
        yield pd.DataFrame(compare(here[0], held) if held else [], columns=names)

    met = recordings.unionByName(asked).repartition("key", "r", "s").sortWithinPartitions("key", "r", "s")
    found = met.mapInPandas(run, "digest long, n long, error double, query long, at int")
    best = found.groupBy("digest").agg(F.sum("n").alias("n_queries"), F.min(F.struct("error", "query", "at")).alias("b"))
    return classes.select("digest", "class_id").join(best, "digest", "left").select(
        "digest", "class_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), "b.query", "b.at", "b.error"
    )


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_codes, fingerprint (hash), class_id, n_queries, query_id, offset, bit_error; nulls without a match."""
    prints = saved(with_fingerprints(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    return prints.join(search(prints, "vec_id"), "digest", "left").select(
        "vec_id",
        F.size("codes").cast("long").alias("n_codes"),
        F.lower(F.lpad(F.hex("digest"), 16, "0")).alias("fingerprint"),
        "class_id",
        F.coalesce("n_queries", F.lit(0)).cast("long").alias("n_queries"),
        F.col("query").alias("query_id"),
        F.col("at").cast("long").alias("offset"),
        F.round("error", 6).alias("bit_error"),
    )
