"""The pipeline and each of its stages, on a test table, on odd rows and on nothing."""

from __future__ import annotations

import pytest

import corpus_pipeline
from gristmill.llm.common import saved

from .conftest import odd_rows
from .test_pii import brute as spans
from .test_quality import brute as measures
from .test_simhash import grouped, near, shingles

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_on_test_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    docs = saved(STAGES["quality"](spark, docs, DATA))
    kept = docs.collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in before if measures(r.text)[-1])
    docs = saved(STAGES["near_duplicates"](spark, docs, DATA))
    sets = [shingles(r.text) for r in kept]
    groups = grouped(len(kept), lambda i, j: near(sets[i], sets[j]))
    least: dict = {}
    for g, r in zip(groups, kept, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    left = docs.collect()
    assert sorted(r.doc_id for r in left) == sorted(least.values())
    docs = saved(STAGES["personal_data"](spark, docs, DATA))
    masked = docs.collect()
    assert len(masked) == len(left) and not any(spans(r.text) for r in masked)
    docs = saved(STAGES["mixing"](spark, docs, DATA))
    mixed = docs.collect()
    assert docs.columns == columns and {r.doc_id for r in mixed} <= {r.doc_id for r in masked}
    words = sum(len(r.text.split()) for r in masked)
    assert abs(sum(len(r.text.split()) for r in mixed) - words) < 0.1 * words
    packed = STAGES["packing"](spark, docs, DATA).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(r.text.split()) for r in mixed)
    assert len(packed) == corpus_pipeline.run(spark, DATA).count()


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, odd, empty, name):
    made = STAGES[name](spark, odd, "")
    assert made.columns[: len(odd.columns)] == odd.columns
    rows = made.collect()
    assert len(rows) <= 4 * len(odd_rows()) and rows
    assert STAGES[name](spark, empty, "").count() == 0


def test_run_on_empty_table(spark, table):
    assert corpus_pipeline.run(spark, table([])).count() == 0


def test_batches_follow_the_curriculum(spark):
    """First positions rise with the batches of a bucket, and copies of a text lie in different batches."""
    from collections import defaultdict

    from gristmill.llm import mixing, packing

    folder = "/root/testdata/sf0.01"
    docs = saved(spark.read.parquet(f"{folder}/documents.parquet"))
    placed = saved(mixing.curriculum(docs, 7))
    pieces = packing.packed(placed, batch_tokens=8192).select("doc_id", "piece", "bucket", "batch", "slot", "mix_position").collect()
    by = defaultdict(list)
    for r in pieces:
        by[r.bucket].append((r.batch, r.slot, r.mix_position, r.doc_id, r.piece))
    for rows in by.values():
        rows.sort()
        assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    batches = {b: rows[-1][0] + 1 for b, rows in by.items()}
    copies = defaultdict(list)
    for r in pieces:
        copies[r.doc_id, r.piece, r.bucket].append(r.batch)
    repeated = {k: v for k, v in copies.items() if len(v) > 1 and batches[k[2]] > 1}
    apart = [len(set(v)) == min(len(v), batches[k[2]]) for k, v in repeated.items()]
    assert len(apart) > 50 and all(len(set(v)) == len(v) for k, v in repeated.items() if batches[k[2]] > 4)
    assert sum(apart) >= 0.8 * len(apart)


def test_many_rows_without_id(spark):
    """Rows of null id do not share a bucket of running sums."""
    from pyspark.sql import functions as F

    from gristmill.llm.common import bucket_of, dealt_by

    df = spark.range(8192).select(dealt_by(F.lit(None).cast("string"), F.col("id")).alias("d"))
    sizes = [r["count"] for r in df.groupBy(bucket_of(F.col("d"), 8192)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 700
