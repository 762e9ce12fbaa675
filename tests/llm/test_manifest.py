"""The manifest: against a plain reading of its rules, and the query against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.llm import manifest

from .conftest import odd_rows, plain, same_columns

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top and, for each leaf, what lies left and right of it on each level."""
    level, at, steps = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, a in enumerate(at):
            run = runs[a // 16]
            steps[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            at[i] = a // 16
        level = [H(*run) for run in runs]
    return level[0], steps


def wanted(rows) -> list[tuple]:
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in by[s]])
    root, upper = tree([trees[s][0] for s in order])
    made = []
    for s, above in zip(order, upper, strict=True):
        for r, own in zip(by[s], trees[s][1], strict=True):
            steps = own + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            d = leaf(r[0], r[1].translate(LOWER), *r[2:]) if hit else leaf(*r)
            for left, right in steps:
                d = H(left, d, right)
            made.append((r[0], leaf(*r), trees[s][0], root, H(*[a + b for a, b in steps]), d, d == root))
    return sorted(made, key=repr)


def compare(spark, folder, rows):
    found = plain(manifest.op13_manifest(spark, folder))
    assert found == wanted(rows)
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    answer = duckdb.sql(manifest.OP13_SQL)
    at = [answer.columns.index(c) for c in manifest.op13_manifest(spark, folder).columns]
    assert sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=repr) == found
    return found


def test_query(spark, table):
    rnd = random.Random(4)
    sources = [None, "", "é", "z", "Z", "-", "=", *[f"s{i}" for i in range(12)]]
    many = [(1000 + i, f"Text {'A' if i % 3 else 'a'} {i}", "en", "hot" if i % 3 == 0 else rnd.choice(sources), i) for i in range(900)]
    many += [(5000 + i, "One", None, f"alone {i}", None) for i in range(3)] + [(7000 + i, "x", "de", "sixteen", 1) for i in range(16)]
    rows = odd_rows() + many
    found = compare(spark, table(rows), rows)
    assert {r[-1] for r in found} == {True, False} and len({r[3] for r in found}) == 1


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_source(spark, table, n):
    rows = [(i, f"T{i}", "en", "only", i) for i in range(n)]
    found = compare(spark, table(rows), rows)
    assert all(r[2] == r[3] for r in found)


def test_nothing(spark, table, odd, empty):
    assert manifest.op13_manifest(spark, table([])).count() == 0
    made = manifest.manifest(empty, ["doc_id", "text"])
    assert made.count() == 0 and same_columns(made.schema, manifest.manifest(odd, ["doc_id", "text"]).schema)


def test_whole_rows(odd):
    clash = odd.withColumnRenamed("kept", "root").withColumnRenamed("first", "steps")
    made = manifest.manifest(clash, ["doc_id", "text"])
    assert {"leaf", "subroot", "root", "root_1", "steps_1"} <= set(made.columns)
    assert plain(made.drop("leaf", "subroot", "root_1", "steps_1")) == plain(clash)


def test_changes_are_seen(odd):
    columns = ["doc_id", "source", "text"]
    made = manifest.manifest(odd.select(*columns), columns)
    assert made.where(manifest.verified(made, columns)).count() == odd.count()
    changed = made.withColumn("text", F.when(F.col("text") == "", None).otherwise(F.col("text")))
    assert changed.where(~manifest.verified(changed, columns)).count() == odd.where("text = ''").count() == 1
