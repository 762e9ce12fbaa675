"""Packing: boundaries against trying all of them, pieces against their texts, batches against their budget."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

from gristmill.llm import packing

from .conftest import odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def padding(histogram: dict[int, int], bounds) -> int:
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_boundaries_are_best():
    rnd = random.Random(2)
    for _ in range(30):
        histogram = {rnd.randint(0, 40): rnd.randint(1, 9) for _ in range(rnd.randint(1, 9))}
        k = rnd.randint(1, 4)
        found = packing.best_boundaries(histogram, k)
        lengths = sorted(histogram)
        tried = [c for m in range(1, k + 1) for c in itertools.combinations(lengths, m) if c[-1] == lengths[-1]]
        assert len(found) <= k and found == sorted(found) and padding(histogram, found) == min(padding(histogram, c) for c in tried)
    assert packing.best_boundaries({}, 3) == []


def test_pieces_make_the_text():
    for text in (None, "", "  \n", prose(1, 9), " lead " + prose(2, 100), prose(3, 64), prose(4, 65), "a\x0bb c " * 50):
        parts = packing.cut(text, 16)
        assert "".join(parts) == (text or "")
        n = len(WORD.findall(text or ""))
        assert [len(WORD.findall(p)) for p in parts] == [16] * (n // 16) + ([n % 16] if n % 16 or not n else [])


def check(rows, texts):
    """rows: (doc_id, piece, n_tokens, bucket, batch, slot)."""
    wanted = sorted(((d, i, min(2048, n - 2048 * i)) for d, n in texts for i in range(max(1, -(-n // 2048)))), key=repr)
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=repr) == wanted
    histogram: dict[int, int] = defaultdict(int)
    for r in rows:
        histogram[r[2]] += 1
        assert r[2] <= r[3]
    bounds = packing.best_boundaries(histogram, packing.BUCKETS)
    assert all(r[3] == min(b for b in bounds if b >= r[2]) for r in rows)
    batches = defaultdict(list)
    for r in rows:
        batches[r[3], r[4]].append(r[5])
    for (bucket, batch), slots in batches.items():
        room = max(1, packing.BATCH_TOKENS // max(bucket, 1))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= room
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(slots) == room


def test_query(spark, table):
    rows = odd_rows() + [(10_000 + i, prose(i, 1 + i * 7 % 300), "en", "s", 0) for i in range(400)]
    texts = [(r[0], len(WORD.findall(r[1] or ""))) for r in rows]
    folder = table(rows)
    found = [tuple(r) for r in packing.op8_packing(spark, folder).collect()]
    check(found, texts)
    assert sorted(found, key=repr) == sorted((tuple(r) for r in packing.op8_packing(spark, folder).collect()), key=repr)
    assert packing.op8_packing(spark, table([])).count() == 0


def test_many_rows_of_one_length(spark):
    pieces = spark.range(9000).selectExpr("id % 4 as k", "0 as pack_piece", "cast(id % 2 as long) * 3 as pack_tokens")
    made = packing.pack(pieces, "k", buckets=2, batch_tokens=30).collect()
    sizes = defaultdict(int)
    for r in made:
        sizes[r.pack_bucket, r.pack_batch] += 1
    assert len(made) == 9000 and sizes[3, 0] == 10 and len({(r.pack_bucket, r.pack_batch, r.pack_slot) for r in made}) == 9000


def test_whole_rows(odd, empty):
    made = packing.packed(odd)
    assert {"piece_1", "n_tokens", "bucket", "batch", "slot"} <= set(made.columns)
    found = made.select("doc_id", "piece_1", "n_tokens", "bucket", "batch", "slot").collect()
    check([tuple(r) for r in found], [(r.doc_id, len(WORD.findall(r.text or ""))) for r in odd.collect()])
    firsts = made.where("piece_1 = 0").select(*[c for c in odd.columns if c != "text"])
    assert sorted(map(repr, firsts.collect())) == sorted(map(repr, odd.drop("text").collect()))
    assert packing.packed(empty).count() == 0
