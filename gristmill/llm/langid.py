"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample: rows are taken by the hash of their id at a rate that gives about
``FIT_DOCS`` a language. Tasks count n-grams of whole texts into a vector for each language; the driver adds a few of
these and broadcasts the log-probability matrix (buckets x languages, 4 bytes each). Scoring sums the rows of the matrix
that a text's n-grams select, a batch of texts at a time.

Edge cases: null text and text without a letter are ``und`` with score 0, as is all if there is nothing to learn from;
texts of any length are scored whole, a block of n-grams at a time; equal scores go to the language that sorts first;
rows of null id are neither held out nor learned from; columns of any other name are carried by ``predict``; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_text

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
SMOOTHING = 0.1
#: Documents a language in the sample that the model is fitted on, about.
FIT_DOCS = 400
#: Numbers of the matrix at most (128 MB): with over 1,024 languages, fewer buckets are used; no language is left out.
MAX_WEIGHTS = 1 << 25
#: Fewest bits of a bucket's number, and so 32,768 languages at most; a column of more is no column of languages.
LEAST_BITS = 10
#: Characters whose n-grams are scored at once.
BLOCK = 1 << 20

_P1, _P2, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def buckets(text: str, bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a lower-cased text, in arrays of at most ``BLOCK`` n-grams of one order."""
    whole = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(whole), BLOCK):
        cp = whole[at : at + BLOCK + ORDERS[-1] - 1]
        h = cp * _P1
        for n in ORDERS:
            if len(cp) < n:
                break
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _P2 + cp[n - 1 :]
            yield ((h[:BLOCK] * _MIX) >> np.uint32(32 - bits)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray  # buckets x languages

    def score(self, text: str | None) -> tuple[str, float]:
        """Language and posterior probability."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        total = self.prior.astype(np.float64)
        size = len(self.weights)
        for b in buckets(text, size.bit_length() - 1):
            if len(b) < 4096:
                total = total + self.weights[b].sum(axis=0, dtype=np.float64)
            else:
                counts = np.bincount(b, minlength=size)
                own = np.flatnonzero(counts)
                total = total + counts[own] @ self.weights[own]
        best = int(np.argmax(total))
        p = np.exp(total - total[best])
        return self.langs[best], float(1.0 / p.sum())


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """Learn from the rows of ``docs`` with a language."""
    known = docs.where(F.col(lang).isNotNull())
    most = MAX_WEIGHTS >> LEAST_BITS
    found = known.groupBy(lang).count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{lang} has more than {most} values; it is no column of languages.")
    if not found:
        return Model((), np.zeros(0), np.zeros((0, 0)))
    langs = tuple(sorted(r[0] for r in found))
    rows = {r[0]: r[1] for r in found}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_docs / rows[k]))])
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit("fit"), text), 11) / F.lit(float(1 << 53))
    sample = known.where(drawn <= F.coalesce(share[F.col(lang)], F.lit(-1.0))).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    bits = min(BUCKET_BITS, (MAX_WEIGHTS // len(langs)).bit_length() - 1)
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for own, body in zip(pdf["l"], pdf["t"], strict=True):
                into = held.setdefault(own, np.zeros(size, dtype=np.int64))
                for b in buckets(body or "", bits):
                    into += np.bincount(b, minlength=size)
        for own, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"l": own, "b": at.astype(np.int32), "n": counts[at]})

    counted = sample.repartition(8).mapInPandas(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    per = counted.groupBy("l").agg(F.collect_list(F.struct("b", "n")).alias("x")).select("l", "x.b", "x.n")
    counts = np.zeros((size, len(langs)))
    for r in per.toLocalIterator():
        counts[np.array(r[1]), langs.index(r[0])] = r[2]
    smooth = counts + SMOOTHING
    weights = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    total = sum(rows.values())
    return Model(langs, np.log(np.array([rows[k] / total for k in langs])), weights)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> dict[str, list]:
        found = [shared.value.score(t) for t in texts]
        return {"lang_pred": [x for x, _ in found], "score": [y for _, y in found]}

    return map_text(docs, text, work, {"lang_pred": "string", "score": "double"}, drop=[text])


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    model = fit(docs.where(remainder(F.col("doc_id")) != 0))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
