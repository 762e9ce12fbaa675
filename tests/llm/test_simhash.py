"""SimHash classes and near-duplicates against comparing all pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
import xxhash

from gristmill.llm import simhash

from .conftest import SCHEMA, edited, odd_rows, plain, prose


def brute_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(n: int, linked) -> list[int]:
    """Least index that each of n items reaches."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(n)]


def shingles(text: str | None) -> frozenset:
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def near(a: frozenset, b: frozenset) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def test_query_equals_all_pairs(spark, table):
    rows = odd_rows() + [(1000 + i, edited(prose(50 + i % 7, 300), i % 4, i), "en", "a", 0) for i in range(80)]
    found = {}
    for doc, fp, c in plain(simhash.op2_simhash(spark, table(rows))):
        found.setdefault(doc, []).append((fp, c))
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = grouped(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    wanted = {}
    for r, fp, g in zip(rows, fps, group, strict=True):
        wanted.setdefault(r[0], []).append((f"{fp:016x}", least.get(g)))
    assert {k: sorted(v, key=repr) for k, v in found.items()} == {k: sorted(v, key=repr) for k, v in wanted.items()}
    assert len({g for g in group}) < len(rows) - 40


@pytest.mark.parametrize("held", [4, 64, 1 << 21])
def test_trie_walk_finds_all_pairs(held):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 8, 300, dtype=np.uint64)
    groups = np.array([0, 1, 40, 41, 200, 300])
    for a, b in itertools.pairwise(groups):
        values[a:b].sort()
    found = [p for part in simhash.trie_pairs(values, groups, 8, 2, held) for p in zip(*(x.tolist() for x in part), strict=True)]
    wanted = {(i, j) for a, b in itertools.pairwise(groups) for i, j in itertools.combinations(range(a, b), 2) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert set(found) <= wanted
    different = {p for p in wanted if values[p[0]] != values[p[1]]}
    assert different <= {tuple(sorted(p)) for p in found}
    label = np.arange(300)
    for p in found:
        label = simhash.merge(label, np.array(p[:1]), np.array(p[1:]))
    assert label.tolist() == grouped(300, lambda i, j: (i, j) in wanted)


def test_similar_pairs_are_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 26))).astype(np.int64) for _ in range(60)]
    wanted = {(i, j) for i, j in itertools.permutations(range(60), 2) if near(frozenset(sets[i].tolist()), frozenset(sets[j].tolist()))}
    assert wanted
    left, right = simhash.similar_pairs(sets, np.zeros(60))
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == wanted
    side = np.arange(60) % 2
    left, right = simhash.similar_pairs(sets, side)
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == {(i, j) for i, j in wanted if side[i] == side[0] != side[j]}


@pytest.mark.parametrize("block", [3, 512])
def test_one_of_each_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LOOSE", 34)  # loose families of many texts that are not alike
    monkeypatch.setattr(simhash, "WIDE", 68)
    texts = [edited(prose(90 + i % 6, 150), (i * 7) % 9, i) for i in range(90)]
    texts += [prose(200, 160), " ".join(prose(200, 160).split()[:140]), "a b c", "A b\tc", "a b d", "", None, " "]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    sets = [shingles(t) for t in texts]
    group = grouped(len(texts), lambda i, j: not (sets[i] or sets[j]) or near(sets[i], sets[j]))
    found = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert found == sorted(set(group))
    assert len(found) < len(texts) - 20


def test_one_of_each_on_odd_rows(odd, empty):
    left = simhash.one_of_each(odd)
    assert left.schema == odd.schema
    rows = left.collect()
    texts = [r.text for r in odd.collect()]
    assert {shingles(r.text) for r in rows} <= {shingles(t) for t in texts}
    classes = grouped(len(texts), lambda i, j: near(shingles(texts[i]), shingles(texts[j])))
    assert len(rows) == len(set(classes))
    by_id = {(r.doc_id, r.text) for r in rows}
    assert (5, prose(1, 120)) in by_id and len([r for r in rows if r.text == prose(1, 120)]) == 1
    whole = {repr(r) for r in odd.collect()}
    assert all(repr(r) in whole for r in rows)
    assert simhash.one_of_each(empty).count() == 0


def test_majority_in_parts():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, (777, 3), dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
    wanted = np.packbits(2 * bits.sum(axis=0, dtype=int) > 777, bitorder="little").view(np.uint64)
    assert (simhash.majority(h, 100) == wanted).all()


def met(a: str, b: str, order: np.ndarray) -> bool:
    """Whether the stage brings two texts into one loose family."""
    x, y = simhash.shingle_set(a), simhash.shingle_set(b)
    if not np.intersect1d(simhash.prefix(x, order), simhash.prefix(y, order)).size:
        return False
    apart = [((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(simhash.sketch(x), simhash.sketch(y), strict=True)]
    sizes = 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y))
    return sizes and apart[0] <= simhash.LOOSE and sum(apart) <= simhash.WIDE or 4 * max(len(x), len(y)) <= 5 * simhash.SHORT


@pytest.mark.parametrize("kind", ["cut", "scattered", "block"])
@pytest.mark.parametrize("n", [5, 10, 30, 45, 60, 300])
def test_pairs_at_the_limit_meet(n, kind):
    """A run of words is cut off or replaced, or words here and there are, so that the sets are just similar enough."""
    order = np.random.default_rng(n).integers(0, 9, simhash.BINS).astype(np.uint8)
    for seed in range(300):
        words = [f"{w}{i}" for i, w in enumerate(prose(seed, n + 4).split())]
        rnd, other = np.random.default_rng(seed), list(words)
        if kind == "cut":
            other = words[: -(n // 5)]
        elif kind == "block":
            k = max(1, n // 9 - 4)
            at = int(rnd.integers(0, n + 4 - k))
            other[at : at + k] = [f"new{i}" for i in range(k)]
        else:
            for i in rnd.choice(n + 4, max(1, n // 45), replace=False):
                other[i] = f"new{i}"
        a, b = " ".join(words), " ".join(other)
        if near(shingles(a), shingles(b)):
            assert met(a, b, order)
        elif kind == "cut":
            raise AssertionError("the cut texts are near-duplicates")


def test_repeated_passage_is_one_class(spark):
    words = [f"w{i}" for i in range(500)]
    passage = [f"p{i}" for i in range(10)]
    few, many = " ".join(words + passage), " ".join(words + passage * 45)
    assert near(shingles(few), shingles(many))
    docs = spark.createDataFrame([(1, few, "en", "a", 0), (2, many, "en", "a", 0), (3, prose(9, 400), "en", "a", 0)], SCHEMA)
    assert [r[0] for r in plain(simhash.one_of_each(docs))] == [1, 3]


def sketches(spark, texts: list[str]):
    order, rows = np.zeros(simhash.BINS, dtype=np.uint8), []
    for i, t in enumerate(texts):
        own = simhash.shingle_set(t)
        rows.append((i, *simhash.sketch(own), len(own), simhash.prefix(own, order).tolist()))
    return spark.createDataFrame(rows, "node long, bits long, check long, n long, prefix array<long>")


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_loose_families_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "KEY_BLOCK", block)
    texts = [edited(prose(60 + i % 3, 90), (i * 5) % 30, i) for i in range(60)] + [prose(70, 20)] * 2 + [edited(prose(70, 20), 4, 1)]
    order = np.zeros(simhash.BINS, dtype=np.uint8)
    wanted = grouped(len(texts), lambda i, j: met(texts[i], texts[j], order))
    nodes = sketches(spark, texts)
    found = {r.node: r.root for r in simhash.components(simhash.fewer(simhash.loose_links(nodes, simhash.shared_keys(nodes)))).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == wanted
    assert 4 < len(set(wanted)) < 50


def test_fewer_links_of_a_large_family(spark):
    base = prose(77, 60)
    nodes = sketches(spark, [edited(base, i % 2, i) for i in range(400)])
    links = simhash.loose_links(nodes, simhash.shared_keys(nodes)).cache()
    made = simhash.fewer(links).cache()
    assert made.count() < 3 * nodes.count()
    assert plain(simhash.components(made)) == plain(simhash.components(links))


def test_rare_shingles_come_first(spark):
    texts = [prose(80, 30) + " " + prose(i, 30) for i in range(40)]
    order = simhash.rare_first(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3))
    counts = np.zeros(simhash.BINS, dtype=np.int64)
    for t in texts:
        np.add.at(counts, simhash.bins(simhash.shingle_set(t)), 1)
    assert (order == np.log2(counts + 1).astype(np.uint8)).all()
    common = set(simhash.shingle_set(prose(80, 30)).tolist())
    assert not any(common & set(simhash.prefix(simhash.shingle_set(t), order).tolist()) for t in texts)


def test_common_shingles_come_last(spark, monkeypatch):
    """A passage of many texts comes last even where bins tell nothing; copies of a text count once."""
    passage = prose(81, 30)
    texts = [passage + " " + prose(i, 30) for i in range(40)] + [prose(300, 40)] * 50 + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    common, rank = simhash.common_shingles(df)
    assert common.tolist() == sorted(common.tolist())
    assert set(simhash.shingle_set(passage).tolist()) <= set(common.tolist()) and len(common) < 40 and set(rank.tolist()) == {5}
    order = simhash.Order(np.full(simhash.BINS, 9, dtype=np.uint8), common, rank)
    assert not any(set(common.tolist()) & set(simhash.prefix(simhash.shingle_set(t), order).tolist()) for t in texts[:40])
    assert not set(simhash.shingle_set(texts[40]).tolist()) & set(common.tolist())
    monkeypatch.setattr(simhash, "COMMON", 10)
    assert not len(simhash.common_shingles(df)[0]) and not len(simhash.common_shingles(df.limit(0))[0])


def test_walk_between_two_tries():
    rng = np.random.default_rng(6)
    values = np.concatenate([np.sort(rng.integers(0, 1 << 10, n, dtype=np.uint64)) for n in (30, 50)])
    found = {p for part in simhash.walk(values, tuple(np.array([x]) for x in (0, 30, 30, 80)), 10, 3) for p in zip(*(x.tolist() for x in part), strict=True)}
    assert found == {(i, j) for i in range(30) for j in range(30, 80) if int(values[i] ^ values[j]).bit_count() <= 3}
