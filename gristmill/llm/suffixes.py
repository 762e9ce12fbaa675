"""Removal of repeated byte strings by a column-wise suffix-array construction over many documents.

Every byte that a string of ``LENGTH`` bytes covers, when that string also starts anywhere else, is removed.

Bringing equal strings together. In a window of ``LENGTH`` bytes the ``ANCHOR``-byte gram with the least hash (the first
of equals) depends on the window's bytes alone, so equal windows have equal anchors at equal offsets. Windows that share
an anchor are one segment; a document has about one segment for each 137 bytes. Segments are counted by anchor, equal
segments collapse to one with a count, and only anchors seen twice go on, one text for each distinct segment.

Construction. The segments of a task are a collection aligned at their anchors. It is built column by column from the
right: each round inserts one symbol of every segment. The transform's column holds, for the suffixes in their order,
the segment of each and the symbol before it; a stable sort by that symbol is the order of the longer suffixes, their
common prefixes follow (1 + the least over the old interval), and the symbols before them are the next column. Symbols,
transform and common prefixes are read and written one after another in external files of a task, so a round holds a few
numbers a segment. Alignment keeps suffixes of different columns apart; they cannot begin equal windows, so only the
column's slice of the transform is updated and a round costs what it inserts. A suffix whose common prefix with a
neighbour reaches ``LENGTH`` begins a repeated window.

Passages. ``shared_passages`` counts, beside what is removed, the strings of ``PASSAGE`` words that a document has in
common with another one. They are sampled by winnowing: of each ``WINNOW`` neighbouring strings the one with the least
hash, so that a passage of ``PASSAGE`` + ``WINNOW`` - 1 = 51 words or more that two documents share gives one at least.

An anchor with more than ``HOT`` distinct segments would be too much for one task: its windows are told apart by 128
bits of hash and counted by Spark instead, which any number of tasks share.

Edge cases: null text is empty; texts shorter than ``LENGTH`` lose nothing; exact copies of at least that length lose
all; repeated rows count as documents of their own; an empty table gives no rows; very long texts are cut in slices that
share ``LENGTH`` - 1 bytes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_text, saved, sieved

LENGTH = 400
ANCHOR = 128
#: Grams in a window.
GRAMS = LENGTH - ANCHOR + 1
COLUMNS = 2 * (GRAMS - 1) + ANCHOR
#: Bytes looked at together; a place in them must fit the low bits of a gram's key.
CHUNK = 1 << 20
#: Documents whose segments are cut at once.
DOCS = 256
#: Segments of one construction, whole anchors.
BATCH = 20_000
#: Words of a string that documents may share, and neighbours of which one is looked at.
PASSAGE, WINNOW = 32, 20
#: Distinct segments of an anchor that one task may hold.
HOT = 1 << 18

_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(CHUNK - 1)


def _grow(h: np.ndarray, step: int, seed: np.uint64 = _A) -> np.ndarray:
    """Hashes of strings twice (or less, by ``step``) as long."""
    out = h[:-step] * seed
    out += h[step:]
    out ^= out >> np.uint64(29)
    out *= _B
    return out


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes at each place."""
    h, size = _TABLE[raw], 1
    while size < ANCHOR:
        h = _grow(h, size)
        size *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima from both ends of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes]) -> pd.DataFrame:
    """A row per segment: doc (index in ``texts``), start, length, offset of its anchor, anchor, content (hashes)."""
    found = []
    chunk: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), CHUNK - LENGTH + 1):
            part = t[at : at + CHUNK]
            if len(part) < LENGTH:
                break
            if held + len(part) > CHUNK:
                found.append(_chunk_segments(chunk))
                chunk, held = [], 0
            chunk.append((i, at, part))
            held += len(part)
    if chunk:
        found.append(_chunk_segments(chunk))
    names = ["doc", "start", "length", "offset", "anchor", "content"]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: np.array([], np.int64) for c in names})


def _chunk_segments(chunk: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    buf = b"".join(p for _, _, p in chunk)
    lens = np.array([len(p) for _, _, p in chunk])
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    h = gram_hashes(np.frombuffer(buf, dtype=np.uint8))
    keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(keys, GRAMS) & _LOW).astype(np.int64)
    part = np.repeat(np.arange(len(chunk)), lens - LENGTH + 1)
    first = np.concatenate([[0], np.cumsum(lens - LENGTH + 1)[:-1]])
    window = np.arange(len(part)) - first[part] + begin[part]
    anchor = at[window]
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
    a, b = np.concatenate([[0], edge]), np.concatenate([edge, [len(part)]]) - 1
    s, e = window[a], window[b] + LENGTH
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(buf[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
    own = part[a]
    return pd.DataFrame(
        {
            "doc": np.array([i for i, _, _ in chunk])[own],
            "start": s - begin[own] + np.array([x for _, x, _ in chunk])[own],
            "length": e - s,
            "offset": anchor[a] - s,
            "anchor": h[anchor[a]].view(np.int64),
            "content": content.view(np.int64),
        }
    )


def repeated_windows(groups: np.ndarray, bodies: list[bytes], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first, last window start in it) of windows that two segments of one group have.

    ``groups`` ascends. One symbol of every segment is inserted a round, from the last column to the first.
    """
    m = len(bodies)
    left = GRAMS - 1 - offsets
    group = np.concatenate([[0], np.cumsum(groups[1:] != groups[:-1])]).astype(np.int64)
    sizes = np.array([len(b) for b in bodies])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as transform, tempfile.TemporaryFile() as prefixes:
        file = np.memmap(symbols, dtype=np.uint16, mode="w+", shape=(COLUMNS, m))
        for x in range(0, m, 4096):
            block = np.zeros((min(4096, m - x), COLUMNS), dtype=np.uint16)
            for i in range(len(block)):
                c = left[x + i]
                block[i, c : c + sizes[x + i]] = np.frombuffer(bodies[x + i], dtype=np.uint8)
            for i in range(len(block)):
                c = left[x + i]
                block[i, c : c + sizes[x + i]] += 1
            file[:, x : x + len(block)] = block.T
        np.arange(m, dtype=np.int32).tofile(transform)
        file[COLUMNS - 1].tofile(transform)
        np.zeros(m, dtype=np.int16).tofile(prefixes)
        on, since = np.zeros(m, dtype=bool), np.zeros(m, dtype=np.int32)
        for column in range(COLUMNS - 1, -1, -1):
            transform.seek(0)
            prefixes.seek(0)
            order = np.fromfile(transform, dtype=np.int32, count=m)
            sign = np.fromfile(transform, dtype=np.uint16, count=m).astype(np.int64)
            common = np.fromfile(prefixes, dtype=np.int16, count=m)
            key = group[order] * 257 + sign
            put = np.argsort(key, kind="stable")
            key, sign = key[put], sign[put]
            new = np.zeros(m, dtype=np.int16)
            next_to = np.flatnonzero((key[1:] == key[:-1]) & (sign[1:] > 0)) + 1
            if len(next_to):
                p, q = put[next_to - 1] + 1, put[next_to]
                least = common[q]
                far = np.flatnonzero(q > p)
                if len(far):
                    ends = np.column_stack([p[far], q[far] + 1]).ravel()
                    least[far] = np.minimum.reduceat(np.append(common, np.int16(0)), ends)[::2]
                new[next_to] = np.minimum(least + 1, LENGTH)
            order = order[put]
            transform.seek(0)
            prefixes.seek(0)
            order.tofile(transform)
            (np.asarray(file[column - 1])[order] if column else np.zeros(m, dtype=np.uint16)).tofile(transform)
            new.tofile(prefixes)
            flag = np.zeros(m, dtype=bool)
            flag[order] = (new >= LENGTH) | np.append(new[1:] >= LENGTH, False)
            shut, opened = np.flatnonzero(on & ~flag), flag & ~on
            if len(shut):
                out.append((shut, column + 1 - left[shut], since[shut] - left[shut]))
            since[opened] = column
            on = flag
        shut = np.flatnonzero(on)
        out.append((shut, 0 - left[shut], since[shut] - left[shut]))
        del file
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _construct(pdf: pd.DataFrame) -> pd.DataFrame:
    """(anchor, content, first[], last[]) of the segments of whole anchors; a segment seen twice is inserted twice."""
    pdf = pdf.drop_duplicates(["anchor", "content"])
    pdf = pdf.iloc[np.repeat(np.arange(len(pdf)), np.minimum(pdf["n"].to_numpy(), 2))].sort_values("anchor", kind="stable")
    own, first, last = repeated_windows(pdf["anchor"].to_numpy(), list(pdf["body"]), pdf["offset"].to_numpy().astype(np.int64))
    rows = pdf[["anchor", "content"]].iloc[own].assign(first=first, last=last).drop_duplicates()
    return rows.astype({"first": np.int32, "last": np.int32})


def _window_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for seed in (_A, _B ^ _A):
        h, size = _TABLE[raw], 1
        while size < LENGTH:
            step = min(size, LENGTH - size)
            h, size = _grow(h, step, seed), size + step
        out.append(h.view(np.int64))
    return out[0], out[1]


def repeats(docs: DataFrame, key: list[str], body: str, hot: int = HOT) -> DataFrame:
    """(``key``, first, last): runs of repeated windows in each row of ``docs``. ``key`` are whole numbers without nulls
    that tell rows with different bytes apart; ``body`` is binary."""
    slim = docs.select(*key, body)
    kinds = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes if c != body)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                found = segments(part.column(len(key)).to_pylist())
                own, start, offset, length, anchor, content = (found[c].to_numpy(dtype=np.int64) for c in ("doc", "start", "offset", "length", "anchor", "content"))
                made = (anchor, content, (start << 32) | (offset << 16) | length)
                columns = [*(part.column(i).take(pa.array(own)) for i in range(len(key))), *map(pa.array, made)]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "anchor", "content", "place"])

    occurrences = saved(slim.mapInArrow(cut, f"{kinds}, anchor long, content long, place long"))
    twice = saved(occurrences.groupBy("anchor").agg(F.count("*").alias("_all")).where("_all > 1").select("anchor"))
    repeated = sieved(occurrences, twice, F.col("anchor"), "_may").where("_may").drop("_may").join(twice, "anchor", "left_semi")
    # grouped by one value, so that Spark counts before it shuffles and deals a common anchor by its contents
    kind = F.struct("anchor", "content").alias("kind")
    counted = repeated.groupBy(kind).agg(F.count("*").alias("n"), F.min(F.struct("place", *key)).alias("at"))
    distinct = saved(counted.select("kind.*", "n", "at"))
    wanted = saved(distinct.join(distinct.groupBy("anchor").agg(F.count("*").alias("_kinds")), "anchor").select("anchor", "content", "n", "_kinds", "at.*"))
    asked = wanted.groupBy(*key).agg(F.collect_list(F.struct("anchor", "content", "n", "place", "_kinds")).alias("asked"))
    holders = sieved(slim, wanted, F.xxhash64(*key), "_may").where("_may").groupBy(*key).agg(F.first(body).alias(body))
    joined = holders.join(asked, key).select(body, "asked")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            rows = []
            for raw, wants in zip(pdf[body], pdf["asked"], strict=True):
                for w in wants:
                    s, o, n = w["place"] >> 32, (w["place"] >> 16) & 0xFFFF, w["place"] & 0xFFFF
                    part = bytes(raw[s : s + n])
                    if digest(part) == w["content"] % (1 << 64):
                        rows.append((w["anchor"], w["content"], w["n"], w["_kinds"], o, part))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["anchor", "content", "n", "kinds", "offset", "body"])
                    rows = []
            yield pd.DataFrame(rows, columns=["anchor", "content", "n", "kinds", "offset", "body"])

    bodies = joined.mapInPandas(texts, "anchor long, content long, n long, kinds long, offset int, body binary")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            held.append(pdf)
            last = pdf["anchor"].iloc[-1]
            if sum(map(len, held)) < BATCH or held[0]["anchor"].iloc[0] == last:
                continue
            whole = pd.concat(held, ignore_index=True)
            tail = (whole["anchor"] == last).to_numpy()
            yield _construct(whole[~tail])
            held = [whole[tail]]
        if held:
            yield _construct(pd.concat(held, ignore_index=True))

    found = (
        (bodies if wanted.where(F.col("_kinds") > hot).isEmpty() else bodies.where(F.col("kinds") <= hot))
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInPandas(build, "anchor long, content long, first int, last int")
    )
    if not wanted.where(F.col("_kinds") > hot).isEmpty():
        found = found.unionByName(_counted(bodies.where(F.col("kinds") > hot)))
    start = F.shiftright("place", 32)
    return repeated.join(found, ["anchor", "content"]).select(
        *key, (start + F.col("first")).alias("first"), (start + F.col("last")).alias("last")
    )


def _counted(bodies: DataFrame) -> DataFrame:
    """The windows of segments of hot anchors that are found twice, as runs of one window."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, c, n, o, raw in zip(pdf["anchor"], pdf["content"], pdf["n"], pdf["offset"], pdf["body"], strict=True):
                x, y = _window_hashes(np.frombuffer(bytes(raw), dtype=np.uint8))
                at = np.arange(len(x), dtype=np.int32)
                yield pd.DataFrame({"anchor": a, "content": c, "n": n, "first": at, "shift": at - np.int32(o), "x": x, "y": y})

    each = bodies.mapInPandas(windows, "anchor long, content long, n long, first int, shift int, x long, y long")
    kinds = ["anchor", "shift", "x", "y"]
    many = each.groupBy(*kinds).agg(F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    return each.join(many, kinds, "left_semi").select("anchor", "content", "first", F.col("first").alias("last"))


def merged(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, end) that windows with these starts cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b + LENGTH)
        else:
            out.append((a, b + LENGTH))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the bytes of the text, and 96 bits of hash that tell rows apart (ids may be null, so they are no key)."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    return docs.select("doc_id", body.alias("body"), F.xxhash64("text", "doc_id").alias("h1"), F.hash("doc_id", "text").alias("h2"))


def _word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash (uint64) of each word."""
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def passage_hashes(raw: bytes) -> np.ndarray:
    """Hashes (signed, distinct) of the sampled strings of ``PASSAGE`` words; of all of a text with fewer than ``WINNOW``
    such strings, the least."""
    h = _word_hashes(raw)
    if len(h) < PASSAGE:
        return np.zeros(0, dtype=np.int64)
    size = 1
    while size < PASSAGE:
        h, size = _grow(h, size), 2 * size
    return np.unique(sliding_min(h, min(WINNOW, len(h)))).view(np.int64)


def shared_passages(docs: DataFrame, key: list[str], body: str) -> DataFrame:
    """(``key``, n_shared): number of sampled strings of ``PASSAGE`` words of a row that a row of another ``key`` has too;
    rows without any are left out. Rows of one key count once."""
    slim = docs.select(*key, body)
    kinds = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes if c != body)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                found = [passage_hashes(x) for x in part.column(len(key)).to_pylist()]
                own = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                columns = [*(part.column(i).take(own) for i in range(len(key))), pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int64)]))]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "passage"])

    strings = saved(slim.mapInArrow(cut, f"{kinds}, passage long"))
    row = F.xxhash64(*key)
    many = strings.groupBy("passage").agg(F.min(row).alias("_low"), F.max(row).alias("_high")).where("_low < _high").select("passage")
    many = saved(many)
    may = sieved(strings, many, F.col("passage"), "_may").where("_may").drop("_may")
    shared = may.join(many, "passage", "left_semi").groupBy(*key)
    return shared.agg(F.size(F.collect_set("passage")).cast("long").alias("n_shared"))  # at most the strings of one text


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_shared: sampled strings of ``PASSAGE`` words that another document has too."""
    docs = _keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    key = ["h1", "h2"]
    runs = repeats(docs, key, "body").groupBy(*key).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    found = saved(runs.join(shared_passages(docs, key, "body"), key, "full"))
    names = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    flagged = sieved(docs, found, F.xxhash64(*key), "may")
    none = F.lit(0).cast("long")
    whole = flagged.where("not may").select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), none.alias("n_shared")
    )
    held = F.struct("body", F.col("runs.first").alias("first"), F.col("runs.last").alias("last")).alias("x")
    joined = flagged.where("may").join(found, key, "left").select("doc_id", F.coalesce("n_shared", none).alias("n_shared"), held)

    def work(rows: list[dict]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in names}
        for r in rows:
            raw, spans = r["body"], merged(r["first"] or [], r["last"] or [])
            edges = [0, *[x for s in spans for x in s], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for name, value in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                out[name].append(value)
        return out

    return whole.unionByName(map_text(joined, "x", work, names, drop=["x"]).select(*whole.columns))
