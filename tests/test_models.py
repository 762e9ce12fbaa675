"""Natural groups by their rules, p-values within Spark, totals of forecasts."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import special, tails
from gristmill.operators import analyses, forecast, groups, significance


def plain_groups(rows: list[list[float | None]]) -> list[int | None]:
    """The rules written out singly: labels from 1 by size."""
    state = 7

    def draw():
        nonlocal state
        state = (state + 0x6D2B79F5) % 2**32
        t = (state ^ state >> 15) * (state | 1) % 2**32
        t ^= (t + (t ^ t >> 7) * (t | 61)) % 2**32
        return (t ^ t >> 14) / 2**32

    width = len(rows[0])
    held = [r for r in rows if sum(v is not None for v in r) >= math.ceil(width / 2)]
    fit = held if len(held) <= 3000 else [held[int(k * len(held) / 3000)] for k in range(3000)]
    stats = []
    for j in range(width):
        xs = sorted(r[j] for r in fit if r[j] is not None)
        m = sum(xs) / len(xs)
        sd = math.sqrt(sum((x - m) ** 2 for x in xs) / max(1, len(xs) - 1)) or 1.0
        stats.append((m, sd, (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2))
    place = lambda r: [((stats[j][2] if v is None else v) - stats[j][0]) / stats[j][1] for j, v in enumerate(r)]
    points = [place(r) for r in fit]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, cs: min(range(len(cs)), key=lambda j: d2(p, cs[j]))
    best = None
    for k in (2, 3, 4, 5):
        if k >= len(points) / 3:
            continue
        centres = [points[int(draw() * len(points))]]
        while len(centres) < k:
            d = [min(d2(p, c) for c in centres) for p in points]
            r, pick = draw() * sum(d), 0
            while pick < len(d) - 1 and r > d[pick]:
                r -= d[pick]
                pick += 1
            centres.append(points[pick])
        labels = [0] * len(points)
        for turn in range(50):
            found = [nearest(p, centres) for p in points]
            moved, labels = found != labels, found
            for j in range(k):
                if own := [p for p, g in zip(points, labels, strict=True) if g == j]:
                    centres[j] = [sum(x) / len(own) for x in zip(*own, strict=True)]
            if not moved and turn:
                break
        n, total = min(600, len(points)), 0.0
        for i in range(n):
            by = {}
            for j in range(n):
                if i != j:
                    by.setdefault(labels[j], []).append(math.dist(points[i], points[j]))
            a = sum(by.get(labels[i], [])) / max(1, len(by.get(labels[i], [])))
            others = [sum(v) / len(v) for g, v in by.items() if g != labels[i]]
            total += (min(others) - a) / max(a, min(others)) if others else 0
        if best is None or total / n > best[0] + 0.02:
            best = total / n, centres
    near = [nearest(place(r), best[1]) if r in held else None for r in rows]
    order = sorted(range(len(best[1])), key=lambda g: -near.count(g))
    return [None if g is None else order.index(g) + 1 for g in near]


@pytest.mark.parametrize("seed", range(4))
def test_overlapping_clouds(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(130):
        c = rnd.choice([(0, 0, 0), (1.6, 1.2, 0), (0.3, 2.4, 1.5)][: 2 + seed % 2])
        rows.append([None if rnd.random() < 0.1 else rnd.gauss(x, 0.8) for x in c])
    rows.append([None, None, 1.0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_rid long, x double, y double, z double")
    made, k = analyses.natural_groups(df, ["x", "y", "z"])
    found = [r.segment for r in made.orderBy("_rid").collect()]
    assert found == plain_groups(rows) and found[-1] is None and k == len(set(found) - {None})


def test_sample_and_words(spark):
    rnd = random.Random(9)
    rows = [[rnd.gauss(*((0, 1) if i % 3 else (9, 1))), rnd.gauss(*((0, 1) if i % 3 else (-7, 1)))] for i in range(3700)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_rid long, x double, y double")
    model = groups.fitted(df, ["x", "y"], 2)
    assert model.quality == "clearly separated"
    shown = model.described(df).orderBy("segment").collect()
    assert [r.size for r in shown] == [2466, 1234] and shown[1].name in ("very high x, very low y", "very low y, very high x") and shown[0].name in ("low x, high y", "high y, low x")
    with pytest.raises(ValueError, match="12 rows"):
        groups.fitted(df.limit(5), ["x", "y"])


def test_tails_in_spark(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice((0.0, rnd.uniform(-9, 9), 60.0, math.inf)), rnd.choice((1.0, 2.5, rnd.uniform(1, 3000))), rnd.uniform(1, 40)) for _ in range(200)]
    df = spark.createDataFrame(rows, "t double, df double, k double")
    made = df.select("*", tails.t_tail(F.col("t"), F.col("df")).alias("p"), tails.f_tail(F.abs("t"), F.col("k"), F.col("df")).alias("q"), tails.chi_tail(F.abs("t") * 4, F.col("k")).alias("c"), tails.lgamma(F.col("df")).alias("g"))
    for r in made.collect():
        assert r.g == pytest.approx(math.lgamma(r.df), rel=1e-10, abs=1e-10)
        assert r.p == pytest.approx(special.t_tail(r.t, r.df), rel=1e-7, abs=1e-12)
        assert r.q == pytest.approx(special.f_tail(abs(r.t), r.k, r.df), rel=1e-7, abs=1e-12)
        if abs(r.t) < 50:
            assert r.c == pytest.approx(special.chi_tail(abs(r.t) * 4, r.k), rel=1e-7, abs=1e-11)


def test_tests_by_group(spark):
    rnd = random.Random(3)
    rows = [(f"b{i % 4}", "xyz"[i % 3], rnd.gauss(i % 3, 1), rnd.gauss(0, 1)) for i in range(300)] + [("one", "x", 1.0, 2.0), (None, "x", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "b string, g string, v double, w double")
    for r in significance.welch_by(df, "b", "g", "v", "x", "y").collect():
        own = significance.welch(df.where(F.col("b") == r.by), "g", "v", "x", "y")
        assert (r.t, r.df, r.p) == pytest.approx((own.t, own.df, own.p), rel=1e-7)
    for r in significance.correlation_by(df, "b", "v", "w").collect():
        own = significance.correlation(df.where(F.col("b") == r.by), "v", "w")
        assert (r.r, r.n, r.p) == pytest.approx((own.r, own.n, own.p), rel=1e-7)
    found = significance.anova_by(df, "b", "g", "v").collect()
    assert len(found) == 4
    for r in found:
        own = significance.anova(df.where(F.col("b") == r.by), "g", "v")
        assert (r.f, r.df1, r.df2, r.eta2) == pytest.approx((own.f, own.df1, own.df2, own.eta2), rel=1e-7) and r.p == pytest.approx(own.p, rel=1e-6, abs=1e-13)


def test_forecast_totals():
    y = np.array([10.0 + t + 3 * (t % 7 == 0) for t in range(60)])
    made = forecast.forecast(y, "day", 14)
    total, low, high = made.total
    assert total == pytest.approx(made.value.sum()) and low < total < high
    falling = forecast.forecast(np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 1, 0]), "year", 5)
    assert falling.total[0] == 0 and falling.total[1] == 0 and falling.total[2] >= 0
