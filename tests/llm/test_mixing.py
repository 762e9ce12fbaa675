"""The mix against one written out by hand, and the order of the curriculum."""

from __future__ import annotations

import hashlib
import re

from gristmill.llm import mixing

from .conftest import odd_rows, plain, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = {s: 3.0 * sizes[s] for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= over


def check(spark, folder, rows):
    size = lambda t: len(WORD.findall(t or ""))
    sources: dict = {}
    for r in rows:
        sources[r[3]] = sources.get(r[3], 0) + size(r[1])
    targets = brute_targets(sources)
    found = mixing.op5_mixing(spark, folder).collect()
    assert sorted([(r.doc_id, r.size, r.source_size) for r in found], key=repr) == sorted([(r[0], size(r[1]), sources[r[3]]) for r in rows], key=repr)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    taken: dict = {}
    for r in found:
        taken.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s, target in targets.items():
        alike = [o for o in targets if (sources[o], round(targets[o], 6)) == (sources[s], round(target, 6))]
        assert abs(sum(taken[sources[s], round(target, 6)]) - target * len(alike)) <= len(alike), s
    assert plain(mixing.op5_mixing(spark, folder)) == sorted(map(tuple, found), key=repr)


def test_odd_rows(spark, table):
    check(spark, table(odd_rows()), odd_rows())


def test_limits_and_many_sources(spark, table):
    rows = [(i, prose(i, 3 + i % 40), "en", ("tiny" if i < 2 else f"s{i % 5}" if i % 2 else "huge"), 0) for i in range(300)]
    check(spark, table(rows), rows)


def test_empty(spark, table, empty):
    assert plain(mixing.op5_mixing(spark, table([]))) == []
    assert mixing.curriculum(empty).count() == 0


def test_curriculum_order_and_copies(spark, odd):
    made = mixing.curriculum(odd, 3)
    assert made.drop("mix_position").schema == odd.schema
    rows = made.collect()
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)
    assert all(0 <= r.mix_position <= 1 for r in rows)
    whole = {repr(r) for r in odd.collect()}
    assert {repr(r) for r in made.drop("mix_position").collect()} <= whole
    assert not any(r.text is None or not WORD.search(r.text) for r in rows)


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    share = spark.range(101).select((F.col("id") / 100).alias("s"))
    for slope in (-0.5, 0.0, 0.5):
        for s, t in share.select("s", mixing.invert_demand(F.col("s"), F.lit(slope))).collect():
            assert abs(t * (1 - slope) + slope * t * t - s) < 1e-9


def test_running_sums_in_buckets(spark):
    from pyspark.sql import functions as F

    from gristmill.llm.common import prefix_sums

    rows = [(None if i % 7 == 0 else f"g{i % 3}", hashlib.md5(str(i).encode()).hexdigest(), i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, h string, n int")
    made = prefix_sums(df, ["g"], [F.col("h")], F.conv(F.substring("h", 1, 1), 16, 10).cast("long"), {"before": "n"})
    seen: dict = {}
    for g, h, n, before in sorted(made.collect(), key=lambda r: r.h):
        assert before == seen.get(g, 0)
        seen[g] = before + n
