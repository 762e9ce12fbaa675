"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are made in the tasks that read the texts. Two words of 64 bits within 2 bits agree in one of three blocks,
and within the rest agree again in one of three: nine keys of 35 or 36 bits bring every pair that can link together, for
nine short rows a fingerprint. Under each key the other bits form a binary trie. Node pairs are walked down together;
a pair of subtries carries the bits in which its paths differ and is dropped when they exceed the budget. A task returns
a spanning forest of the links that it finds, never all pairs, and star contraction joins the forests to components.

``classes`` links fingerprints of one word (the contract of ``op2_simhash``). ``near_duplicates`` finds texts whose sets
of five-word shingles have a Jaccard similarity of 0.8 or more. Such texts differ in 15% of the bits, so keys made of
bits would have to be short, and their groups would grow with the corpus. Texts are filed under shingles instead: with
all shingles in one order, two such sets share a shingle among the first fifth of each, so no pair is lost. The order
puts rare shingles first, by the counts of ``BINS`` bins over all texts, and those that many texts have last, by counts
of their own (``common_shingles``); it decides what is compared, never the result.
Under each shingle that texts have in common, the first 64 bits of their SimHash form a trie that is joined with itself
within ``LOOSE`` bits, and what is found must agree within ``WIDE`` of 128 bits and in its number of shingles. Sets at
the limit differ in more bits than that in about one of 80,000 cases; texts of few shingles, whose bits are
rougher, go on without that. A large key is dealt to a grid of blocks. What links gives loose families; in a family, texts like
its leading one are its class at once, and the others are compared exactly with all, in blocks, so no task holds a large
family and a family of copies of one text takes a comparison each.

Edge cases: null text and text without words have fingerprint 0, linked like any other, and no shingles, so they are one
class; texts of fewer words than a shingle are one shingle; a text of any length is fingerprinted whole in its task; repeated rows share a class; null ids come last, so they name
a class only if it has no other id; an empty table gives no rows; other columns may have any type and name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ensure_checkpoint_dir, fresh, map_text, saved, sieved

MAX_BITS = 2
SHINGLE = 3
SEED = 42
#: Words in a shingle and similarity (as a fraction) of near-duplicates.
NEAR_SHINGLE, NEAR = 5, (4, 5)
#: Bits of 64 and of 128 in which loose pairs differ at most, and shingles of the texts that are not held to that.
LOOSE, WIDE, SHORT = 24, 38, 40
#: Bins that shingles are counted in, and bins of a row of counts.
BINS, BIN_BLOCK = 1 << 20, 1 << 14
#: One text in so many shows which shingles are common, how often one must be seen for that, and how many are told by themselves.
SAMPLED, SEEN, COMMON = 16, 8, 1 << 20
#: Nodes of a block of one key.
KEY_BLOCK = 1 << 14
#: Texts, and shingles of them, of a block of a family.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Node pairs of a trie walk that are held at once.
FRONTIER = 1 << 16

_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def majority(hashes: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Words (rows x words, as uint64, to one row) of the bits that over half the rows have."""
    total = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step])
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of lower-cased (A-Z) word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, n - shingle + 1)
    return int(majority(h.reshape(-1, 1))[0])


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A 64-bit hash (uint64) of each shingle of lower-cased (A-Z) words, repeats included."""
    words = (text or "").encode().lower().split()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(each))
    n = len(each) - size + 1 if size else 0
    out = each[:n].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * _MIX + each[k : k + n]
    return (out ^ (out >> np.uint64(32))) * _SPREAD


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes (signed, ascending) of the shingles that near-duplicates share."""
    return np.unique(shingle_hashes(text, NEAR_SHINGLE).view(np.int64))


def sketch(own: np.ndarray) -> tuple[int, int]:
    """SimHash of 128 bits of a set of shingles as two signed longs."""
    if not len(own):
        return 0, 0
    h = own.view(np.uint64)
    h = (h ^ (h >> np.uint64(31)))[:, None] * np.array([_MIX, _SPREAD])
    low, high = majority(h ^ (h >> np.uint64(32))).view(np.int64)
    return int(low), int(high)


def bins(own: np.ndarray) -> np.ndarray:
    return (own.view(np.uint64) >> np.uint64(24)).astype(np.int64) & (BINS - 1)


@dataclass(frozen=True)
class Order:
    """The order of all shingles: those of ``common`` (ascending) last, by ``rank``, and before them all others by the number of
    their bin; shingles of equal numbers go by their hash."""

    bins: np.ndarray
    common: np.ndarray
    rank: np.ndarray

    def numbers(self, own: np.ndarray) -> np.ndarray:
        found = self.bins[bins(own)]
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, own), len(self.common) - 1)
            hit = self.common[at] == own
            found[hit] = 64 + self.rank[at[hit]]
        return found


def prefix(own: np.ndarray, order: Order | np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which each near-duplicate of it has one among its own. ``order`` may be a number for each
    bin alone."""
    if not len(own):
        return own
    p, q = NEAR
    numbers = order.numbers(own) if isinstance(order, Order) else order[bins(own)]
    return own[np.argsort(numbers, kind="stable")[: len(own) + (-p * len(own)) // q + 1]]


def with_fingerprints(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long in place of the text."""

    def work(texts: list[str | None]) -> dict[str, Any]:
        return {name: np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_text(docs, text, work, {name: "long"}, drop=[text])


def _layouts() -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each of the nine keys, the bit ranges (low, width) of the key and of the rest."""

    def thirds(ranges: list[tuple[int, int]]) -> Iterator[tuple[list, list]]:
        at = [(low + k) for low, width in ranges for k in range(width)]
        cuts = [0, (len(at) + 2) // 3, (2 * len(at) + 2) // 3, len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield _runs(at[a:b]), _runs(at[:a] + at[b:])

    return [(first + second, rest) for first, others in thirds([(0, 64)]) for second, rest in thirds(others)]


def _runs(bits: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b in bits:
        if out and out[-1][0] + out[-1][1] == b:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


LAYOUTS = _layouts()
REST_BITS = max(sum(w for _, w in rest) for _, rest in LAYOUTS)


def _gather(word: Column, ranges: list[tuple[int, int]], base: int = 0) -> Column:
    out, at = F.lit(0).cast("long"), 0
    for low, width in ranges:
        part = F.shiftrightunsigned(word, base + low).bitwiseAND(F.lit((1 << width) - 1))
        out, at = out.bitwiseOR(F.shiftleft(part, at)), at + width
    return out


def trie_pairs(values: np.ndarray, groups: np.ndarray, bits: int, budget: int, held: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``values`` of one group that differ in at most ``budget`` of the low ``bits``, in parts.

    ``values`` ascend within each group; ``groups`` holds the groups' starts and the end.
    """
    lo, hi = groups[:-1], groups[1:]
    big = hi - lo > 1
    return walk(values, (lo[big], hi[big], lo[big], hi[big]), bits, budget, held)


def walk(values: np.ndarray, ranges: tuple[np.ndarray, ...], bits: int, budget: int, held: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits between the tries of two ranges of ascending values, a0..a1 and b0..b1, for all
    ranges at once. Two equal ranges are a trie with itself.

    A step goes down one bit; a row of the frontier is a pair of nodes (ranges of values) and the bits they differ in.
    A frontier of more than ``held`` pairs is halved and the halves are walked one after the other. Equal values end in
    one leaf and count as pairs of its first with each other one.
    """
    before: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        """Number of values before each place that have the bit; kept for few values, as the parts ask again."""
        if bit in before:
            return before[bit]
        count = np.zeros(len(values) + 1, dtype=np.int32)
        np.cumsum((values >> np.uint64(bit)) & np.uint64(1), out=count[1:], dtype=np.int32)
        if len(values) <= 1 << 17:
            before[bit] = count
        return count

    waiting = [(bits - 1, *ranges, np.zeros(len(ranges[0]), dtype=np.int8))]
    while waiting:
        bit, a0, a1, b0, b1, err = waiting.pop()
        if not len(a0):
            continue
        if len(a0) > held:
            half = len(a0) // 2
            waiting.append((bit, *(x[half:] for x in (a0, a1, b0, b1, err))))
            waiting.append((bit, *(x[:half] for x in (a0, a1, b0, b1, err))))
            continue
        if bit < 0:
            yield _leaves(a0, a1, b0, b1)
            continue
        ones = ones_before(bit)
        am = a1 - (ones[a1] - ones[a0])
        bm = b1 - (ones[b1] - ones[b0])
        same, cross = a0 == b0, a0 != b0
        x0 = np.concatenate([a0, am, a0, am[cross]])
        x1 = np.concatenate([am, a1, am, a1[cross]])
        y0 = np.concatenate([b0, bm, bm, b0[cross]])
        y1 = np.concatenate([bm, b1, b1, bm[cross]])
        e = np.concatenate([err, err, err + 1, err[cross] + 1])
        own = np.concatenate([same, same, np.zeros(len(a0) + int(cross.sum()), dtype=bool)])
        keep = (x1 > x0) & (y1 > y0) & (e <= budget) & ~(own & (x1 - x0 < 2))
        waiting.append((bit - 1, x0[keep], x1[keep], y0[keep], y1[keep], e[keep]))


def _leaves(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a leaf's members with another's, or of a leaf's first member with its others."""
    same = a0 == b0
    n = np.where(same, a1 - a0 - 1, (a1 - a0) * (b1 - b0))
    at = np.repeat(np.arange(len(a0)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    wide = np.where(same, 1, b1 - b0)[at]
    left = a0[at] + np.where(same[at], 0, k // wide)
    return left, b0[at] + np.where(same[at], k + 1, k % wide)


def merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (least index reached so far) after the links (left, right) are added."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        new = label.copy()
        np.minimum.at(new, np.maximum(a, b), np.minimum(a, b))
        while (new[new] != new).any():
            new = new[new]
        label = new


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest (u, v) of the links of whole groups (k, key) of fingerprints."""
    k, key, rest, node = (pdf[c].to_numpy() for c in ("k", "key", "rest", "node"))
    order = np.lexsort((rest, key, k))
    k, key, rest, node = k[order], key[order], rest[order].astype(np.uint64), node[order]
    cut = (key[1:] != key[:-1]) | (k[1:] != k[:-1])
    groups = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(order)]])
    label = np.arange(len(order))
    for left, right in trie_pairs(rest, groups, REST_BITS, MAX_BITS):
        label = merge(label, left, right)
    u, v = spanning(node, label)
    return pd.DataFrame({"u": u, "v": v})


def _loose_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest (u, v) of the loose links of whole groups (k, key) of nodes with bits, check and n (shingles).

    Nodes near the least of their group are linked to it first, so only the others' tries are joined with the whole.
    """
    k, key, node, n = (pdf[c].to_numpy() for c in ("k", "key", "node", "n"))
    bits, check = (pdf[c].to_numpy().view(np.uint64) for c in ("bits", "check"))
    order = np.lexsort((bits, key, k))
    k, key, bits, check, node, n = (x[order] for x in (k, key, bits, check, node, n))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (k[1:] != k[:-1])])
    lo = np.flatnonzero(new)
    hi, group, place = np.append(lo[1:], len(order)), np.cumsum(new) - 1, np.arange(len(order))

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(bits[a] ^ bits[b])
        sizes = NEAR[1] * np.minimum(n[a], n[b]) >= NEAR[0] * np.maximum(n[a], n[b])
        return sizes & (apart <= LOOSE) & (apart + np.bitwise_count(check[a] ^ check[b]) <= WIDE)

    lead = np.zeros(len(lo), dtype=np.int64)
    own = node == np.minimum.reduceat(node, lo)[group]
    lead[group[own]] = place[own]
    near = alike(place, lead[group])
    label = merge(place, place[near], lead[group[near]])
    few = np.flatnonzero(4 * n <= 5 * SHORT)
    if len(few):  # all of a group's short texts
        first = np.concatenate([[True], group[few][1:] != group[few][:-1]])
        label = merge(label, few, few[np.flatnonzero(first)[np.cumsum(first) - 1]])
    far = np.flatnonzero(~near)
    if len(far):
        m, count = len(order), np.bincount(group[far], minlength=len(lo))
        a1, some = m + np.cumsum(count), count > 0
        for left, right in walk(np.concatenate([bits, bits[far]]), (a1[some] - count[some], a1[some], lo[some], hi[some]), 64, LOOSE):
            left = far[left - m]
            fits = alike(left, right)
            label = merge(label, left[fits], right[fits])
    u, v = spanning(node, label)
    return pd.DataFrame({"u": u, "v": v})


def spanning(node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least node of its label; under other keys the same family mostly has the same least."""
    least = node.copy()
    np.minimum.at(least, label, node)
    least = least[label]
    apart = node != least
    return node[apart], least[apart]


def _links(keyed: DataFrame, forest: Callable[[pd.DataFrame], pd.DataFrame], rows: int = 100_000) -> DataFrame:
    """Links (u, v) that ``forest`` finds in whole groups (k, key) of ``keyed``, some rows' worth at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            first, last = held[0].iloc[0], pdf.iloc[-1]
            if sum(map(len, held)) < rows or (first.k == last.k and first.key == last.key):
                continue
            whole = pd.concat(held, ignore_index=True)
            tail = ((whole["k"] == last.k) & (whole["key"] == last.key)).to_numpy()
            yield forest(whole[~tail])
            held = [whole[tail]]
        if held:
            yield forest(pd.concat(held, ignore_index=True))

    dealt = keyed.repartition(F.col("k"), F.col("key")).sortWithinPartitions("k", "key")
    return dealt.mapInPandas(run, "u long, v long").distinct()


def links(fps: DataFrame, name: str) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints just as all pairs within ``MAX_BITS`` bits do."""
    fp = F.col(name)
    each = [F.struct(F.lit(i).alias("k"), _gather(fp, key).alias("key"), _gather(fp, rest).alias("rest")) for i, (key, rest) in enumerate(LAYOUTS)]
    return _links(fps.select(fp.alias("node"), F.explode(F.array(*each)).alias("x")).select("node", "x.*"), _forest)


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, b): shingles of the prefixes of ``nodes`` that several nodes have, and the blocks of each."""
    filed = nodes.select("node", F.explode("prefix").alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return filed.join(sizes, "key").select("key", "node", F.ceil(F.col("m") / KEY_BLOCK).cast("int").alias("b"))


def loose_links(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """Links (u, v) between nodes that share a shingle of their prefixes and are alike in their bits and sizes. ``nodes``
    has node, bits, check and n (shingles)."""
    met = shared.join(nodes.select("node", "bits", "check", "n"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("b")).cast("int")
    cells = met.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("b") - 1))})
    cell = F.greatest("own", "other") * 65536 + F.least("own", "other")
    return _links(cells.select(cell.alias("k"), "key", "node", "bits", "check", "n"), _loose_forest)


def fewer(links: DataFrame) -> DataFrame:
    """Links (u, v) that connect the same nodes: each u is linked to its least v alone, and its other v to that one. A u
    has at most one v for each of its keys; families have few different v, so most of the new links are equal."""
    grouped = links.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("all"))
    return grouped.select(F.explode(F.concat(F.array("u"), "all")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of undirected ``edges`` (u, v) reaches.

    Alternating large-star and small-star steps; each is a grouped minimum and a join, so a hub with many links is never
    gathered. Every round is checkpointed in the shared folder.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = now.agg(F.count("*"), mark).first()
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = small.distinct().checkpoint()
        found = now.agg(F.count("*"), mark).first()
        if found == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found


def classes(fingerprinted: DataFrame, key: str, name: str) -> DataFrame:
    """One row per distinct fingerprint: ``name`` and component_id, the least ``key`` in its component."""
    fps = saved(fingerprinted.groupBy(name).agg(F.min(key).alias("_least")))
    joined = fps.join(components(links(fps.select(name), name)), F.col(name) == F.col("node"), "left")
    rooted = joined.select(name, "_least", F.coalesce("root", name).alias("_root"))
    low = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rooted.join(low, "_root").select(name, "component_id")


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, share: tuple[int, int] = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ascending arrays without repeats whose Jaccard similarity is at least ``share``; where ``side``
    has two values, only pairs between the two. Empty sets are alike."""
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    values, owner = np.concatenate([*sets, np.array([], dtype=np.int64)]), np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1
    owner = owner[shared]
    column = np.unique(column[shared], return_inverse=True)[1]
    a = np.flatnonzero(side == side[0])
    b = np.flatnonzero(side != side[0]) if (side != side[0]).any() else a
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        x, y = np.searchsorted(column, (low, low + 4096))
        has = np.zeros((m, 4096), dtype=np.float32)
        has[owner[x:y], column[x:y] - low] = 1
        both += has[a] @ has[b].T
    p, q = share
    i, j = np.nonzero((p + q) * both.astype(np.int64) >= p * (n[a][:, None] + n[b][None, :]))
    left, right = a[i], b[j]
    return left[left != right], right[left != right]


def in_groups(df: DataFrame, keys: list[str], order: list[Column], work: Callable[[list[Any]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``work`` makes of the rows of each group ``keys``; a group has a bounded number of rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = dict(zip(names, (x.split()[1] for x in schema.split(", ")), strict=True))
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({n: "int64" if t == "long" else "bool" for n, t in types.items()})
    k = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, []
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False, name=None):
                if row[:k] != here:
                    found += work(held) if held else []
                    here, held = row[:k], []
                held.append(row[k:])
            yield frame(found)
        yield frame(work(held) if held else [])

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def like_first(texts: DataFrame) -> DataFrame:
    """(root, node, alike): whether each other node of a family is a near-duplicate of its leading one. ``texts`` has
    root, node, lead, block, blocks and text; the leading text is copied to each block."""
    every = F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    placed = texts.select("root", F.explode(every).alias("at"), "lead", "node", "text")

    def work(rows: list[Any]) -> list[tuple]:
        """Rows are (lead, node, text), the leading one first."""
        found = np.zeros(len(rows), dtype=bool)
        if len(rows) > 1:
            found[similar_pairs([shingle_set(r[2]) for r in rows], np.arange(len(rows)) > 0)[1]] = True
        return [(r[1], f) for r, f in zip(rows[1:], found[1:].tolist(), strict=True)]

    return in_groups(placed, ["root", "at"], [F.col("lead").desc()], work, "node long, alike boolean")


def similar_links(texts: DataFrame) -> DataFrame:
    """Links (u, v) that connect the nodes of a family just as all pairs of near-duplicates do, compared exactly.

    ``texts`` has root (the family), node, n (shingles), lead (one node of each family), block, blocks and text. Nodes
    like the leading one are linked to it; each of the others is compared with all nodes, in a grid of blocks of others
    and of all. Texts are shuffled, not their shingles, which take thrice the room.
    """
    first = texts.where("lead").select("root", F.col("node").alias("v"))
    alike = saved(like_first(texts))
    settled = texts.select("root", "node").join(alike.where("alike"), "node").join(first, "root").select(F.col("node").alias("u"), "v")
    apart = texts.join(alike.where("not alike").select("node"), "node", "left_semi")
    rows = saved(apart.select("root", "node", "n", "blocks", "text"))
    sizes = rows.groupBy("root").agg(F.count("*").alias("others"), F.sum("n").alias("all"))
    cut = F.greatest(F.ceil(F.col("others") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    cut = sizes.select("root", cut.alias("cuts"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int")
    asking = rows.join(cut, "root").select(
        "root", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("asks"), "node", "text"
    )
    asked = sieved(texts, cut, F.col("root"), "may").where("may").join(cut, "root").select(
        "root", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), "node", "text"
    )

    def work(rows: list[Any]) -> list[tuple]:
        """Spanning links of the pairs of an asking and another row (asks, node, text)."""
        asks, node = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        if asks.all() or not asks.any():
            return []
        left, right = similar_pairs([shingle_set(r[2]) for r in rows], asks)
        ids = np.unique(node, return_inverse=True)
        label = merge(np.arange(len(ids[0])), ids[1][left], ids[1][right])
        return list(zip(*spanning(ids[0], label), strict=True))

    crossed = in_groups(asking.unionByName(asked), ["root", "i", "j"], [], work, "u long, v long")
    return settled.unionByName(crossed).distinct()


def rare_first(texts: DataFrame) -> np.ndarray:
    """A number for each of ``BINS`` bins of shingles, that rises with the shingles of all ``texts`` in it (its binary
    logarithm). Tasks count into arrays and Spark adds them; the driver gets a byte a bin."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, dtype=np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                np.add.at(total, bins(shingle_set(t)), 1)
        if total.any():
            yield pd.DataFrame({"at": range(BINS // BIN_BLOCK), "counts": [x.tobytes() for x in np.minimum(total, 0xFFFF).astype(np.uint16).reshape(-1, BIN_BLOCK)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at, raw in zip(pdf["at"], pdf["counts"], strict=True):
                held[at] = held.get(at, 0) + np.frombuffer(raw, dtype=np.uint16).astype(np.int64)
        for at, total in held.items():
            yield pd.DataFrame({"at": [at], "counts": [np.log2(total + 1).astype(np.uint8).tobytes()]})

    counted = texts.select("text").mapInPandas(count, "at int, counts binary").repartition("at").mapInPandas(add, "at int, counts binary")
    order = np.zeros(BINS, dtype=np.uint8)
    for r in counted.collect():
        order[r.at * BIN_BLOCK : (r.at + 1) * BIN_BLOCK] = np.frombuffer(bytes(r.counts), dtype=np.uint8)
    return order


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many different texts have, ascending, and the binary logarithms of how many of the sampled ones do.

    Bins hold the more different shingles the larger the corpus, so a passage of some thousand texts no longer stands out in
    them; counted by themselves its shingles do, at any size. One different text in ``SAMPLED`` is looked at, which
    only moves what is compared. The ``COMMON`` commonest at most are told (16 MB); with more, the least number of texts rises.
    """
    h = F.xxhash64("text")
    one = texts.select("text", h.alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")).where(F.pmod("h1", F.lit(SAMPLED)) == 0)
    one = one.groupBy("h1", "h2").agg(F.first("text").alias("text")).select("text")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                yield pd.DataFrame({"s": np.concatenate(list(map(shingle_set, pdf["text"].iloc[at : at + 256])))})

    counted = one.mapInPandas(each, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    counted = saved(counted.withColumn("level", F.floor(4 * F.log2("n")).cast("int")))
    total, least = 0, None
    for r in counted.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
        total += r["k"]
        if total > COMMON:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    found = counted.where(F.col("level") >= least).select("s", (F.col("level") / 4).cast("int").alias("rank")).toArrow()
    values = found.column("s").to_numpy()
    order = np.argsort(values)
    return values[order], found.column("rank").to_numpy()[order].astype(np.uint8)


#: What tells texts apart.
SAME_TEXT = ["h1", "h2"]


def sketched(texts: DataFrame) -> DataFrame:
    """``texts`` with bits, check, n (shingles) and prefix in place of the text."""
    order = texts.sparkSession.sparkContext.broadcast(Order(rare_first(texts), *common_shingles(texts)))

    def work(batch: list[str | None]) -> dict[str, Any]:
        out: dict[str, list] = {"bits": [], "check": [], "n": [], "prefix": []}
        for t in batch:
            own = shingle_set(t)
            for name, value in zip(out, (*sketch(own), len(own), prefix(own, order.value)), strict=True):
                out[name].append(value)
        return out

    return map_text(texts, "text", work, {"bits": "long", "check": "long", "n": "long", "prefix": "array<long>"}, drop=["text"])


def near_duplicates(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root): classes of near-duplicate texts of two members or more. ``texts`` has h1, h2 and text, any number of
    rows a text; ``nodes`` has each text once with node (a number of its own), h1, h2, bits, check, n and prefix."""
    shared = saved(shared_keys(nodes))
    loose = components(fewer(loose_links(nodes, shared)))
    family = loose.unionByName(loose.select(F.col("root").alias("node"), "root")).distinct()
    # texts without shingles are one class and need no comparison
    member = family.join(nodes.where("n > 0").select("node", "n", F.size("prefix").alias("p"), *SAME_TEXT), "node")
    # the text that copies were made of has no shingles of its own, so it leads
    common = shared.groupBy("node").agg(F.count("*").alias("common"))
    member = member.join(common, "node", "left").withColumn("own", F.col("p") - F.coalesce("common", F.lit(0)))
    sizes = member.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("all"), F.min(F.struct("own", "node")).alias("first"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sized = member.join(sizes.where("m > 1").select("root", blocks.alias("blocks"), F.col("first.node").alias("leader")), "root")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = saved(sized.select(*SAME_TEXT, "root", "node", "n", (F.col("node") == F.col("leader")).alias("lead"), block.alias("block"), "blocks"))
    may = sieved(texts.select(*SAME_TEXT, "text"), placed, F.col("h1"), "may").where("may").drop("may")
    once = may.groupBy(*SAME_TEXT).agg(F.first("text").alias("text")).join(placed, SAME_TEXT).drop(*SAME_TEXT)
    return components(similar_links(saved(once)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates left: the one with the least doc_id (null ids come last,
    and among rows of one id the one with the least hash of its text); of rows equal in both, the first by source and
    language. Texts are told apart by 128 bits of hash."""
    same_id, h1, h2, flag, picked = (fresh(docs, f"near_{c}") for c in ("id", "h1", "h2", "may", "row"))
    text = F.coalesce("text", F.lit(""))
    hashes = {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("second"), text)}
    slim = docs.select("doc_id", *[x.alias(n) for n, x in hashes.items()], "text")
    id_ = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("h1").alias("h1"), F.col("h2").alias("h2"))
    made = [F.first(c).alias(c) for c in ("bits", "check", "n", "prefix")]
    grouped = sketched(slim).groupBy(*SAME_TEXT).agg(F.min(id_).alias("first"), *made)
    nodes = saved(grouped.withColumn("node", F.monotonically_increasing_id()))
    found = near_duplicates(nodes, slim).withColumnRenamed("node", "member")
    one = F.when(F.col("n") == 0, F.lit(-1)).otherwise(F.coalesce("root", "node"))  # empty texts are alike
    rooted = nodes.join(found, F.col("node") == F.col("member"), "left").groupBy(one.alias("class"))
    stay = rooted.agg(F.min("first").alias("f")).select(F.col("f.id").alias(same_id), F.col("f.h1").alias(h1), F.col("f.h2").alias(h2))
    ours = [F.col("doc_id").eqNullSafe(F.col(same_id)), F.col("h1") == F.col(h1), F.col("h2") == F.col(h2)]
    counted = slim.groupBy("doc_id", *SAME_TEXT).agg(F.count("*").alias("rows"))
    gone = counted.join(stay.withColumn("stays", F.lit(True)), ours, "left").select("doc_id", *SAME_TEXT, F.col("stays").isNull().alias("go"), "rows")
    # rows that are not to go as they are: they go, or stay once
    marked = saved(gone.where("go or rows > 1").select(F.col("doc_id").alias(same_id), F.col("h1").alias(h1), F.col("h2").alias(h2), "go"))
    hashed = docs.withColumns({h1: hashes["h1"], h2: hashes["h2"]})
    flagged = sieved(hashed, marked, F.col(h1), flag)
    clear = flagged.where(~F.col(flag)).drop(flag, h1, h2)
    go = marked.where("go").select(F.col(same_id), F.col(h1).alias("g1"), F.col(h2).alias("g2"))
    same = [F.col("doc_id").eqNullSafe(F.col(same_id)), F.col(h1) == F.col("g1"), F.col(h2) == F.col("g2")]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(picked)
    by = F.struct(*[F.col(c).isNull() for c in ("source", "lang") if c in docs.columns], *[F.col(c) for c in ("source", "lang") if c in docs.columns], F.lit(0))
    packed = flagged.where(F.col(flag)).select("doc_id", h1, h2, whole, by.alias("by")).join(go, same, "left_anti")
    kept = packed.groupBy("doc_id", h1, h2).agg(F.min_by(picked, "by").alias(picked)).select(f"{picked}.*")
    return clear.unionByName(kept)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    slim = saved(with_fingerprints(docs, "text", "fp"))
    found = classes(slim, "doc_id", "fp")
    return slim.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
