"""Personal data: base spans against the patterns as written, the field against summing over all labellings."""

from __future__ import annotations

import hashlib
import itertools
import re
import time

import numpy as np
import pytest

from gristmill.llm import pii

from .conftest import odd_rows, plain, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


TRICKY = [
    "a@b@c.de x@y.z@w.v .a.@-.- a@b..c a@b.c.d.@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.3.4 1.2.3.4567.8.9.1 9.9.9.9.",
    "4539148803436467 4539-1488-0343-6467 4539 1488 0343 6467 0 45391488034364671 12345678901234567890", "+49 30 1234567 +1(2).3-4 5 6789 +1 2 +123456789012345678 ++41791234567+",
    "é@b.c ü4539148803436467 ١٢٣٤.5.6.7 😀 jo@x.org", "+" * 50 + "1 2", "@" * 40 + ".a", "1-2 3-4 5-6 7 8 9 0 1 2 3", "",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_random_base_spans():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        text = "".join(rng.choice(list("019.@+- (a)b%\n"), rng.integers(1, 60)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in ("a" * 400_000, "a.b@" * 100_000, "1." * 200_000, "1 " * 200_000, "+1" + " " * 400_000, "@a" * 200_000, "+1 " * 150_000):
        pii.find([text], None)
    assert time.perf_counter() - began < 20


def test_messages_give_marginals_of_a_tree():
    rng = np.random.default_rng(1)
    k = len(pii.KINDS) + 1
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    features = rng.normal(size=(4, pii.N_FEATURES)) / 4
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    weight = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        score = sum(float((features[i] @ field.own)[y[i]]) for i in range(4)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in skip)
        for i in range(4):
            weight[i, y[i]] += np.exp(score)
    assert np.allclose(field.marginals(features, chain, skip, rounds=200), weight / weight.sum(axis=1, keepdims=True), atol=1e-6)


def test_repeats_are_linked_however_far_apart():
    g = pii.graph("id 4539148803436467 " + prose(1, 400) + " 4539-1488-0343-6467 and 10.0.0.1 10.0.0.1")
    assert g.skip.tolist() == [[0, 1], [2, 3]] and g.chain.tolist() == [[2, 3]]


def test_query(spark, table):
    rows = odd_rows() + [(500 + i, t, None, None, None) for i, t in enumerate(TRICKY)]
    found = {r.doc_id: r for r in pii.op9_pii(spark, table(rows)).collect()}
    for doc, text, *_ in rows:
        if doc in (None, 5, 7):
            continue
        base = brute(text or "")
        r = found[doc]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r.spans.split(",")) | {""}
        assert r.n_spans == len([x for x in r.spans.split(",") if x])
    assert plain(pii.op9_pii(spark, table([]))) == []


def test_repeats_take_the_label_of_their_likes():
    known = [f"write to user{i}@mail{i}.example.com or call +49 30 {1234567 + i} now {i}" for i in range(200)]
    graphs = [pii.graph(t) for t in known]
    field = pii.train(graphs, [pii.labels(g, pii.base_spans(t)) for g, t in zip(graphs, known, strict=True)])
    for t, (base, added) in zip(known, pii.find(known, field), strict=True):
        assert base == brute(t)
        assert all(not (a < y and x < b) for _, a, b in added for _, x, y in base)


def test_redaction(odd, empty):
    made = pii.redact(odd)
    assert made.schema == odd.schema
    by_id = {r.doc_id: r for r in made.collect() if r.doc_id is not None}
    text = by_id[18].text
    assert not brute(text) and text.startswith("mail me at <EMAIL> or <IP>, card <CARD>, call <PHONE>") and by_id[18].n_chars == len(text)
    assert by_id[0].text is None and by_id[9].text == prose(2, 40)
    assert all(not brute(r.text or "") for r in made.collect())
    assert plain(made.drop("text", "n_chars", "piece")) == plain(odd.drop("text", "n_chars", "piece"))
    assert pii.redact(empty).count() == 0
