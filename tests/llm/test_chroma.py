"""Audio fingerprints: filters by plain sums, alignment of shifted recordings, recall against comparing all."""

from __future__ import annotations

import numpy as np
import pytest

from gristmill.llm import chroma

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def melody(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.125, n)


def test_filters_by_plain_sums():
    frames = chroma.chroma(chroma.sonified(melody(1, 30)))
    assert np.allclose(np.linalg.norm(frames, axis=1), 1)
    found = chroma.codes(frames)
    wide = np.concatenate([frames, frames], axis=1)
    for t in (0, 5, len(found) - 1):
        bits = 0
        for kind, p, dp, dt in chroma.FILTERS:
            box = lambda a, da, q, dq: wide[t + a : t + a + da, q : q + dq].sum()  # noqa: E731, B023
            whole, h, w = box(0, dt, p, dp), dp // 2, dt // 2
            plus = {
                "pitch": lambda: box(0, dt, p, h), "time": lambda: box(0, w, p, dp),
                "cross": lambda: box(0, w, p, h) + box(w, dt - w, p + h, dp - h), "middle": lambda: box(0, dt, p + dp // 3, dp - 2 * (dp // 3)),
            }[kind]()
            level = sum((2 * plus - whole) / dt >= x for x in chroma.THRESHOLDS)
            bits = bits << 2 | (0, 1, 3, 2)[level]
        assert found[t] == bits


def test_shifted_and_noisy_recordings_align():
    code = chroma.codes(chroma.chroma(chroma.sonified(melody(2, 60))))
    assert chroma.align(code, code[7:]) [0] == -7 and chroma.align(code[7:], code)[0] == 7
    noise = code.copy()
    noise[::5] ^= np.uint32(3)
    at, votes, error = chroma.align(code, noise)
    assert at == 0 and votes >= 3 and 0 < error < chroma.ERROR
    other = chroma.codes(chroma.chroma(chroma.sonified(melody(3, 60))))
    assert chroma.align(code, other)[2] > chroma.ERROR
    assert chroma.align(code[:0], code) == (0, 0, 1.0)


def brute(rows):
    codes = {i: chroma.codes(chroma.chroma(chroma.sonified([] if v is None else v))) for i, v in rows}
    asks = [i for i in codes if i % 20 == 0]
    pairs = set()
    for q in asks:
        for r in codes:
            if len(codes[q]) > 1 and len(codes[r]) > 1:
                _, votes, error = chroma.align(codes[q], codes[r])
                if votes >= chroma.VOTES and error <= chroma.ERROR:
                    pairs.add((q, r))
    return codes, pairs


@pytest.mark.parametrize("block", [3, 1024])
def test_search_recall(spark, table, monkeypatch, block):
    monkeypatch.setattr(chroma, "BLOCK", block)
    rows = [(int(i), [float(x) for x in melody(i % 23, 40)[(i // 23) % 5 :]], 0) for i in range(200)] + [(400, None, 0), (401, [], 0), (402, [0.1], 0), (403, [0.0] * 30, 0)]
    codes, pairs = brute([(r[0], r[1]) for r in rows])
    found = {r.vec_id: r for r in chroma.op3_chroma(spark, table(rows, SCHEMA, "embeddings")).collect()}
    assert len(found) == len(rows) and found[400].n_codes == 0 and found[400].class_id is None
    matched = {r for _, r in pairs}
    got = {i for i, r in found.items() if r.n_queries}
    assert got <= matched and len(got) >= 0.9 * len(matched)
    for i, r in found.items():
        if r.n_queries:
            at, votes, error = chroma.align(codes[r.query_id], codes[i])
            assert (at, round(error, 6)) == (r.offset, r.bit_error) and r.query_id % 20 == 0 or r.query_id in {min(j for j in codes if (len(codes[j]) == len(codes[q]) and (codes[j] == codes[q]).all())) for q in codes if q % 20 == 0}
        same = [j for j in codes if len(codes[j]) > 1 and len(codes[j]) == len(codes[i]) and (codes[j] == codes[i]).all()]
        assert r.class_id == (min(same) if len(codes[i]) > 1 else None)


def test_recall_on_test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    _, pairs = brute(rows)
    found = {r.vec_id: r.n_queries for r in chroma.op3_chroma(spark, DATA).collect()}
    matched = {r for _, r in pairs}
    assert sum(found[i] > 0 for i in matched) >= 0.9 * len(matched) and len(found) == len(rows)


def test_empty(spark, table):
    assert chroma.op3_chroma(spark, table([], SCHEMA, "embeddings")).count() == 0


def test_no_pair_is_lost(spark, table):
    """Counts of matches equal those of comparing all pairs, for short parts of long recordings too."""
    long = [float(x) for x in melody(500, 300)]
    rows = [(20 * i, long[i * 17 : i * 17 + 24 + i], 0) for i in range(12)] + [(1001, long, 0), (1002, [float(x) for x in melody(501, 300)], 0)]
    rows += [(2001 + i, [x + float(e) for x, e in zip(long[i * 17 : i * 17 + 60], melody(600 + i, 60) / 20, strict=True)], 0) for i in range(12)]
    _, pairs = brute([(r[0], r[1]) for r in rows])
    others = sum(q != r for q, r in pairs)
    found = {r.vec_id: r.n_queries for r in chroma.op3_chroma(spark, table(rows, SCHEMA, "embeddings")).collect()}
    assert others >= 20 and found == {r[0]: sum(x == r[0] for _, x in pairs) for r in rows}


def test_offsets_are_those_of_all_pairs():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        a, b = (rnd.integers(0, rnd.integers(1, 6), rnd.integers(0, 40)).repeat(rnd.integers(1, 4)).astype(np.uint32) for _ in range(2))
        wanted = np.zeros(len(a) + len(b) + 4, dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                wanted[j - i + len(a)] += x == y
        for pairs in (1, 7, 1 << 20):
            assert (chroma.offsets(a, b, pairs) == wanted).all()


def test_an_hour_of_silence():
    n = 3600 * chroma.RATE // chroma.HOP
    silence = np.zeros(n, dtype=np.uint32)
    assert chroma.align(silence, silence[100:]) == (-100, n - 100, 0.0) or chroma.align(silence, silence[100:])[1:] == (n - 100, 0.0)
    noise = np.random.default_rng(1).integers(0, 2**32, n, dtype=np.uint32)
    mixed = np.concatenate([silence[:9000], noise[:20_000], silence[:5000]])
    assert chroma.align(noise[500:15_000], mixed) == (9500, 14_500, 0.0)
