"""Repeated byte strings against a table of all windows."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import suffixes

from .conftest import odd_rows, prose


def brute(texts: list[str | None]) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    n = suffixes.LENGTH
    counts = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - n + 1):
            if counts[r[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_shared(docs: list[tuple]) -> list[int]:
    """Sampled strings of words of each (id, text) that a row of another id or text has."""
    sampled, n = [], suffixes.WINNOW
    for _, t in docs:
        w = (t or "").encode().split()
        grams = [b" ".join(w[i : i + suffixes.PASSAGE]) for i in range(len(w) - suffixes.PASSAGE + 1)]
        h = suffixes_hashes(w)[: len(grams)]
        of = dict(zip(h, grams, strict=True))
        sampled.append({of[min(h[i : i + n])] for i in range(max(len(h) - n + 1, 1))} if h else set())
    holders: dict = {}
    for d, s in zip(docs, sampled, strict=True):
        for g in s:
            holders.setdefault(g, set()).add(d)
    return [sum(len(holders[g]) > 1 for g in s) for s in sampled]


def suffixes_hashes(words: list[bytes]) -> list[int]:
    """The hash of each string of words, from the words alone."""
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    size, a, b, mask = 1, int(suffixes._A), int(suffixes._B), (1 << 64) - 1
    while size < suffixes.PASSAGE:
        grown = []
        for x, y in zip(h, h[size:], strict=False):
            z = (x * a + y) & mask
            grown.append(((z ^ (z >> 29)) * b) & mask)
        h, size = grown, 2 * size
    return h


def test_shared_passages_of_51_words_are_seen(spark, table):
    words = [f"w{i}" for i in range(51)]
    texts = [" ".join([f"a{i}_{k}" for i in range(k)] + words + [f"b{i}_{k}" for i in range(40)]) for k in range(25)]
    texts += [" ".join(words[:31] + [f"c{i}" for i in range(60)]), " ".join(f"d{i}" for i in range(90))]
    found = {r.doc_id: r.n_shared for r in suffixes.op6_suffixes(spark, table([(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert all(found[i] > 0 for i in range(25)) and found[25] == found[26] == 0


def rows() -> list[tuple]:
    shared, other = prose(1, 120), prose(2, 90, "")
    texts = [prose(10, 50) + shared + prose(11, 20), prose(12, 5) + shared, shared[:399], shared[1:401] + "é", other * 4, "ab" * 700, "z" * 399, "z" * 400, "z" * 403]
    texts += [prose(20 + i, 30) + shared[i * 9 :] + other[: 40 * i] + prose(40 + i, 10) for i in range(12)]
    texts += [prose(300, 1500), "q" + prose(300, 1500)[:5000] + "é" * 300, "é" * 350]
    return [(2000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]


def check(spark, folder, all_rows):
    found = sorted((tuple(r) for r in suffixes.op6_suffixes(spark, folder).collect()), key=repr)
    shared = brute_shared([(r[0], r[1]) for r in all_rows])
    assert found == sorted(((r[0], *b, s) for r, b, s in zip(all_rows, brute([r[1] for r in all_rows]), shared, strict=True)), key=repr)


def test_query(spark, table):
    every = odd_rows() + rows()
    check(spark, table(every), every)


@pytest.mark.parametrize("chunk", [1 << 11])
def test_slices_of_long_texts(spark, table, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "_LOW", np.uint64(chunk - 1))
    monkeypatch.setattr(suffixes, "BATCH", 5)
    check(spark, table(rows()), rows())


def test_extra_columns(spark, table, odd):
    folder = table(odd.withColumns({"h1": F.lit("x"), "body": F.lit(1.5), "anchor": F.lit(None).cast("binary"), "may": F.lit(True)}))
    check(spark, folder, odd_rows())


def test_hot_anchors(spark, table, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(suffixes.repeats, "__defaults__", (2,))
    check(spark, table(rows()), rows())


def test_empty(spark, table):
    assert suffixes.op6_suffixes(spark, table([])).count() == 0


def test_construction_round_by_round():
    rng = np.random.default_rng(2)
    bodies, groups, offsets = [], [], []
    common = bytes(rng.integers(97, 99, 700).tolist())
    for g in range(3):
        for i in range(5):
            bodies.append(bytes(rng.integers(97, 99, 100).tolist()) + common[g : g + 128 + 272] + bytes(rng.integers(97, 99, i).tolist()))
            groups.append(g)
            offsets.append(150)
    own, first, last = suffixes.repeated_windows(np.array(groups), bodies, np.array(offsets))
    found = {(int(o), w) for o, a, b in zip(own, first, last, strict=True) for w in range(a, b + 1)}
    n = suffixes.LENGTH
    wanted = {(i, w) for i, b in enumerate(bodies) for w in range(len(b) - n + 1) if any(j != i and groups[j] == groups[i] and bodies[j][w : w + n] == b[w : w + n] for j in range(len(bodies)))}
    assert found == wanted and wanted
