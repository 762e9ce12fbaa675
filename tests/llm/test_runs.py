"""Periodic runs: against trying every period at every place, and the query against its SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from gristmill.llm import runs

from .conftest import odd_rows, plain, prose, same_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words) -> list[tuple[int, int, int]]:
    """Every stretch of every period that cannot grow, without those that have a smaller period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(rnd: random.Random) -> list[int]:
    """Random symbols with runs of many periods, whole and broken, next to and inside each other."""
    made: list[int] = []
    for _ in range(rnd.randint(1, 6)):
        letters = rnd.randint(1, 9)
        unit = [rnd.randrange(letters) for _ in range(rnd.randint(1, 40))]
        made += (unit * rnd.randint(1, 9))[: rnd.randint(1, 200)]
        if rnd.random() < 0.4:
            made += [rnd.randrange(50) for _ in range(rnd.randint(0, 9))]
        if made and rnd.random() < 0.3:
            made[rnd.randrange(len(made))] = 99
        if rnd.random() < 0.2:
            made = (made * 5)[:400]
    return made


def test_all_runs():
    rnd = random.Random(1)
    for _ in range(1500):
        words = planted(rnd)
        assert runs.find_runs(words) == brute(words), words
    for _ in range(1500):
        words = [rnd.randrange(rnd.choice((1, 2, 3))) for _ in range(rnd.randint(0, 60))]
        assert runs.find_runs(words) == brute(words), words


@pytest.mark.parametrize("q", range(1, 70))
def test_each_period_at_its_least_length(q):
    rnd = random.Random(q)
    for at in range(9):
        for length in (max(6, 4 * q) - 1, max(6, 4 * q), max(6, 4 * q) + 1):
            words = [1000 + i for i in range(at)] + [i % q for i in range(length)] + [2000 + rnd.randrange(9) for _ in range(3)]
            assert runs.find_runs(words) == ([(at, length, q)] if length >= max(6, 4 * q) else [])


def test_long_texts():
    assert runs.find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    unit = list(range(777)) * 250
    assert runs.find_runs([*unit, 5, *unit[:40]]) == [(0, len(unit), 777)]
    # Fibonacci words have many repeats but no fourth power
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert runs.find_runs(b) == []


def test_words_that_stay():
    words = [f"w{i}" for i in (0, 7, 8, 7, 8, 7, 8, 7, 8, 1, 1, 1, 1, 1, 1, 2)]
    found = runs.find_runs(words)
    assert found == [(1, 8, 2), (9, 6, 1)]
    assert runs.kept_words(words, found) == ["w0", "w7", "w8", "w1", "w2"]
    assert runs.kept_words([], []) == []


def wanted(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = runs.find_runs(words) if n > 500 else brute(words)
    keep = np.ones(n, bool)
    for s, length, q in found:
        keep[s + q : s + length] = False
    from fractions import Fraction

    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for w, k in zip(words, keep, strict=True) if k)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_query(spark, table):
    rnd = random.Random(3)
    rows = odd_rows() + [(1000 + i, " ".join(f"v{x}" for x in planted(rnd)) if i % 5 else prose(i, 130), "en", "s", 0) for i in range(150)]
    folder = table(rows)
    found = plain(runs.op11_runs(spark, folder))
    assert found == sorted((wanted(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in found) > 60 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    answer = duckdb.sql(runs.OP11_SQL)
    at = [answer.columns.index(c) for c in runs.op11_runs(spark, folder).columns]
    assert sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=repr) == found
    assert runs.op11_runs(spark, table([])).count() == 0


def test_whole_rows(odd, empty):
    clash = odd.withColumnRenamed("kept", "runs")
    made = runs.with_runs(clash)
    assert {"runs", "runs_1", "collapsed"} <= set(made.columns)
    assert plain(made.drop("runs_1", "collapsed")) == plain(clash)
    assert same_columns(runs.with_runs(empty).schema, runs.with_runs(odd).schema) and runs.with_runs(empty).count() == 0
