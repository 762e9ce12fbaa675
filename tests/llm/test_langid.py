"""Language identification: its sums against a plain classifier, and accuracy on held-out documents."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from gristmill.llm import langid

from .conftest import odd_rows, plain, prose

DATA = "/root/testdata/sf0.01"


def test_buckets_do_not_depend_on_blocks(monkeypatch):
    text = prose(3, 900) + "ÄÖ😀"
    whole = np.sort(np.concatenate(list(langid.buckets(text))))
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert (np.sort(np.concatenate(list(langid.buckets(text)))) == whole).all()
    assert len(whole) == sum(len(text) - n + 1 for n in langid.ORDERS)


def test_score_is_that_of_naive_bayes():
    rng = np.random.default_rng(1)
    weights = np.log(rng.dirichlet(np.ones(1 << langid.BUCKET_BITS), 3).T).astype(np.float32)
    model = langid.Model(("a", "b", "c"), np.log(np.array([0.2, 0.3, 0.5])), weights)
    for text in (prose(4, 3), prose(5, 4000)):
        total = [float(model.prior[k]) + sum(float(weights[b, k]) for part in langid.buckets(text) for b in part.tolist()) for k in range(3)]
        best = max(range(3), key=total.__getitem__)
        lang, score = model.score(text)
        assert lang == "abc"[best] and score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total), rel=1e-3)


def test_query_on_odd_rows(spark, table):
    rows = plain(langid.op4_langid(spark, table(odd_rows())))
    assert len(rows) == len(odd_rows())
    held = {r[0]: r[1] for r in rows}
    for doc, *_ in odd_rows():
        assert held[doc] == (doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0)
    lang = {r[0]: r[2:] for r in rows}
    assert lang[0] == lang[1] == lang[2] == ("und", 0.0) and lang[12][0] in ("en", "fr")
    assert all(0 <= r[3] <= 1 for r in rows)


def test_nothing_to_learn_from(spark, table):
    unlabelled = [(r[0], r[1], None, r[3], r[4]) for r in odd_rows()]
    assert {r[2] for r in plain(langid.op4_langid(spark, table(unlabelled)))} == {"und"}
    assert plain(langid.op4_langid(spark, table([]))) == []


def test_rows_pass_through(odd):
    model = langid.fit(odd)
    out = langid.predict(odd, model)
    assert out.drop("lang_pred", "score").schema == odd.drop("text").schema
    assert plain(out.drop("lang_pred", "score", "piece")) == plain(odd.drop("text", "piece"))


def test_more_languages_take_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_WEIGHTS", 3 << 12)
    docs = spark.createDataFrame([(i, prose(i, 30), ("xx", "yy", "zz")[i % 3]) for i in range(30)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ("xx", "yy", "zz") and model.weights.shape == (1 << 12, 3)
    assert model.score(prose(4, 30))[0] == "yy"
    monkeypatch.setattr(langid, "MAX_WEIGHTS", 2 << langid.LEAST_BITS)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in langid.op4_langid(spark, DATA).collect() if r.held_out and r.lang_pred != "und" and labels[r.doc_id]]
    right = sum(r.lang_pred == labels[r.doc_id] for r in held)
    assert len(held) > 100 and right / len(held) >= 0.97
