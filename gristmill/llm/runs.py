"""Periodic runs: stretches of consecutive words that repeat with one period at least four times.

A run of period q has ``max(LEAST, REPEATS * q)`` words or more. Words are numbered by their first place, so a text is a sequence
of integers. A run holds an aligned block of every power of two up to (3q + 1) / 2 words with the same block q words on.
So for each power of two the aligned blocks are integer-sequence keys of an Aho-Corasick automaton that searches the
sequence; two places of a block at a distance within that block's scale (each distance belongs to one power of two) seed an
exact extension to both sides. What it finds is the whole run, so each run is found whatever its length.

Two exact prunings keep plain prose cheap. Every pair of neighbouring words of a run occurs at least three times in its text, so
only stretches of such pairs are searched. And where a block comes back at equal steps, only the first step is a seed: the
others have that step as a smaller period.

Edge cases: a null text has no words and no runs, and so has an empty or blank one; a text is searched whole in its task,
whatever its length, with memory in proportion to it; ties of the longest run go to the smaller start, then period; repeated rows
and rows of null id are rows of their own; an empty table gives no rows; ``with_runs`` carries other columns of any name and type.
"""

from __future__ import annotations

import re
from collections.abc import Hashable, Sequence
from typing import Any

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, fresh, map_text

#: Repeats and words that a run has at least.
REPEATS, LEAST = 4, 6
Run = tuple[int, int, int]
_WORD = re.compile(WORD)


def numbered(words: Sequence[Hashable]) -> np.ndarray:
    """Words as integers: equal words have equal numbers."""
    known: dict[Hashable, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: [from, to) of the longest stretches whose neighbouring pairs all occur ``REPEATS`` - 1 times."""
    if len(ids) < LEAST:
        return []
    _, of, times = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True, return_counts=True)
    often = np.concatenate([[False], times[of] >= REPEATS - 1, [False]])
    if not often.any():
        return []
    begin, end = np.flatnonzero(often[1:] & ~often[:-1]), np.flatnonzero(often[:-1] & ~often[1:])
    return [(int(a), int(b) + 1) for a, b in zip(begin, end, strict=True) if b + 1 - a >= LEAST]


def places_of_blocks(symbols: tuple[int, ...], size: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each different aligned block of ``size`` symbols its aligned places and all its places, ascending."""
    keys: dict[tuple[int, ...], int] = {}
    aligned: list[list[int]] = []
    for at in range(0, len(symbols) - size + 1, size):
        block = symbols[at : at + size]
        k = keys.setdefault(block, len(keys))
        if k == len(aligned):
            aligned.append([])
        aligned[k].append(at)
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for block, k in keys.items():
        found.add_word(block, k)
    found.make_automaton()
    places: list[list[int]] = [[] for _ in keys]
    for end, k in found.iter(symbols):
        places[k].append(end - size + 1)
    return aligned, places


def seeds(aligned: list[int], places: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """(distance, place) of an aligned block and a later place of it at a distance of ``low`` to ``high``.

    Of places that follow at equal steps only the first counts; a later one repeats with that step already.
    """
    steps = len(places) - 1
    reach = list(range(1, steps + 2))  # the last place that equal steps lead to from each
    for i in range(steps - 2, -1, -1):
        if places[i + 1] - places[i] == places[i + 2] - places[i + 1]:
            reach[i] = reach[i + 1]
    found, i = [], 0
    for at in aligned:
        while places[i] < at:
            i += 1
        j = i + 1
        while j <= steps and (d := places[j] - at) <= high:
            if d >= low:
                found.append((d, at))
            j = reach[i] + 1 if j == i + 1 else j + 1
    return found


def extended(w: np.ndarray, at: int, size: int, d: int) -> tuple[int, int]:
    """The longest stretch [from, to) around a block, and its like ``d`` on, whose words ``d`` apart are equal."""
    left, right, last = at, at + size, len(w) - d
    step = 16
    while right < last:
        stop = min(right + step, last)
        differ = w[right:stop] != w[right + d : stop + d]
        k = int(differ.argmax())
        if differ[k]:
            right += k
            break
        right, step = stop, 2 * step
    step = 16
    while left > 0:
        stop = max(left - step, 0)
        differ = (w[stop:left] != w[stop + d : left + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            left -= k
            break
        left, step = stop, 2 * step
    return left, right + d


def has_smaller_period(w: np.ndarray, begin: int, end: int, d: int) -> bool:
    """Whether a stretch of period ``d`` also has a proper part of it as a period."""
    rest, p, parts = d, 2, []
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            parts.append(d // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return any(np.array_equal(w[begin : end - f], w[begin + f : end]) for f in parts)


def find_runs(words: Sequence[Hashable]) -> list[Run]:
    """All runs as (start, length, period), by start, then period."""
    ids = numbered(words)
    found: set[Run] = set()
    for a, b in stretches(ids):
        w = ids[a:b]
        symbols, size = tuple(w.tolist()), 2
        while REPEATS * (low := (2 * size + 1) // 3) <= len(symbols):
            high = (4 * size + 1) // 3 - 1  # the periods from low to high belong to blocks of this size
            near = [s for one, all_ in zip(*places_of_blocks(symbols, size), strict=True) if len(all_) > 1 for s in seeds(one, all_, low, high)]
            before, end = -1, -1
            for d, at in sorted(near):
                if d == before and at + size + d <= end:
                    continue  # within the stretch that was extended last
                begin, end = extended(w, at, size, d)
                before = d
                if end - begin >= max(LEAST, REPEATS * d) and not has_smaller_period(w, begin, end, d):
                    found.add((a + begin, end - begin, d))
            size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: Sequence[str], runs: Sequence[Run]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return list(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]


def _runs_of(texts: list[str | None]) -> dict[str, list[Any]]:
    runs, kept = [], []
    for text in texts:
        words = _WORD.findall(text or "")
        found = find_runs(words)
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
        kept.append(" ".join(kept_words(words, found)))
    return {"runs": runs, "collapsed": kept}


RUN_TYPE = "array<struct<start:long,length:long,period:long>>"


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with runs (array of start, length, period, by start, then period) and collapsed, the words that stay when each
    run keeps its first period, joined by one space (runs_1, collapsed_1 if there are such columns)."""
    named = {"runs": fresh(docs, "runs"), "collapsed": fresh(docs, "collapsed")}
    work = lambda texts: {named[k]: v for k, v in _runs_of(texts).items()}
    return map_text(docs, text, work, {named["runs"]: RUN_TYPE, named["collapsed"]: "string"})


def cycled(text: Column, hashed: Column) -> Column:
    """The words of a text, joined by one space, with those from word a = g % n on taken in turn from p words from a on;
    g = floor(hashed / 10), p = 1 + floor((n - a) / (3 + g % 8)). The text itself has words, n in number."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, g = F.size(words), F.floor(hashed / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(turns), F.lit(1), n - a)), " ")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of runs, its run of the greatest length by period, and digests of all runs and of what
    stays. Documents whose hashed id is a multiple of ten are searched with their words taken in turn; a null id has no hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changes = (hashed % 10 == 0) & (F.regexp_count("text", F.lit(WORD)) > 0)
    docs = docs.withColumn("text", F.when(changes, cycled(F.col("text"), hashed)).otherwise(F.col("text")))
    found = with_runs(docs).drop("text")
    ahead = lambda a, b: F.when(a.length * b.period > b.length * a.period, -1).when(
        a.length * b.period < b.length * a.period, 1
    ).when(a.start != b.start, F.signum(a.start - b.start).cast("int")).otherwise(F.signum(a.period - b.period).cast("int"))
    best = F.get(F.array_sort("runs", ahead), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 of a text of decimal digits, by a table that the generator polynomial gives.
CRC32 = """
crc_table AS (
  SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t
  FROM range(0, 256) u(i))"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text, with the table ``crc_table`` in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"


OP11_SQL = rf"""
WITH {CRC32.strip()},
taken AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS original,
    CASE WHEN doc_id IS NOT NULL THEN {crc32_sql("CAST(doc_id AS VARCHAR)")} END AS h
  FROM documents, crc_table),
sized AS (SELECT *, len(original) AS n, h // 10 AS g FROM taken),
placed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
cycles AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
texts AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN original
    ELSE list_transform(range(0, n), lambda i: original[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS ws
  FROM cycles),
words AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM texts),
pairs AS (
  SELECT x.r, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
periodic AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM periodic GROUP BY r, start, length),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
ratios AS (SELECT *, (length * 4611686018427387904::HUGEINT) // period AS ratio FROM runs),
best AS (SELECT * FROM ratios QUALIFY row_number() OVER (PARTITION BY r ORDER BY ratio DESC, start, period) = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.r = w.r AND g.i = w.i GROUP BY w.r)
SELECT t.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
  CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept k USING (r)
"""
