"""Operators on small tables with known results."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import formatting, special
from gristmill.functions.formula import FormulaError, calculate, compiled
from gristmill.functions.values import join_key, natural_key, number_text
from gristmill.operators import analyses, answers, charts, cleaning, combine, forecast, insights, profile, series, significance, sorting, stats, summarize, texts
from gristmill.operators.filters import Filter, search, where
from gristmill.operators.summarize import Agg
from gristmill.plans import recipe
from gristmill.sinks import projects


def rows(df):
    return [tuple(r) for r in df.collect()]


# formulas

SHOP = [("Coffee", 3.5, 2.0, "2024-03-01", True), ("Tea", 2.0, None, "2024-03-09", False), ("cake", 4.25, 1.0, None, None)]


@pytest.fixture(scope="module")
def shop(spark):
    df = spark.createDataFrame(SHOP, "name string, price double, qty double, d string, member boolean")
    return df.withColumn("date", F.to_timestamp("d")).drop("d")


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("price * qty", [7.0, None, 4.25]), ("-2 ^ 2", [-4.0] * 3), ("2 ^ 3 ^ 0", [2.0] * 3), ("1 / 0", [None] * 3), ("7 % 4 - 1", [2.0] * 3), ("-7 % 4", [-3.0] * 3),
        ("name = 'COFFEE'", [True, False, False]), ("name & '!' & qty", ["Coffee!2", "Tea!", "cake!1"]), ("if(member, 1, 0)", [1.0, 0.0, 0.0]), ("not member", [False, True, None]),
        ("qty > 1 or price > 4", [True, False, True]), ("round(-2.5) + round(2.345, 2)", [-2 + 2.35] * 3), ("max(qty, price)", [3.5, 2.0, 4.25]), ("member + 1", [2.0, 1.0, None]),
        ("year(date) * 100 + month(date)", [202403.0, 202403.0, None]), ("weekday(date)", ["Fri", "Sat", None]), ("left(name, -2)", ["Coff", "T", "ca"]), ("len([name])", [6.0, 3.0, 4.0]),
        ("contains(name, 'EA')", [False, True, False]), ("coalesce(qty, 9)", [2.0, 9.0, 1.0]), ("bucket(price, 2)", ["2–4", "2–4", "4–6"]), ("log(0)", [None] * 3), ("'a' < 'B'", [True] * 3),
        ("isMissing(qty)", [False, True, False]), ("upper(trim(' x ')) & lower('Y')", ["Xy"] * 3), ("sqrt(-1)", [None] * 3), ("daysBetween(date, date)", [0.0, 0.0, None]), ("yes and 'text'", [True] * 3),
    ],
)
def test_formula(shop, source, wanted):
    found = [r[0] for r in shop.select(compiled(source, shop).c).collect()]
    assert [round(x, 9) if isinstance(x, float) else x for x in found] == [round(x, 9) if isinstance(x, float) else x for x in wanted]


@pytest.mark.parametrize("source", ["", "price *", "prise + 1", "foo(1)", "round()", "(1 + 2", "1 $ 2", "if(1, 2)", "price qty"])
def test_formula_errors(shop, source):
    with pytest.raises(FormulaError):
        compiled(source, shop)


def test_formulas_against_python(spark):
    rnd = random.Random(4)
    data = [(float(rnd.randint(-9, 9)), float(rnd.randint(-9, 9)) if rnd.random() < 0.8 else None) for _ in range(20)]
    df = spark.createDataFrame(data, "a double, b double")

    def made(depth: int):
        if depth == 0 or rnd.random() < 0.2:
            k = rnd.choice(("a", "b", float(rnd.randint(0, 5))))
            return (k, lambda r: r[k]) if isinstance(k, str) else (repr(k), lambda r: k)
        op = rnd.choice("+-*/")
        (s, f), (t, g) = made(depth - 1), made(depth - 1)

        def value(r):
            x, y = f(r), g(r)
            if x is None or y is None or op == "/" and y == 0:
                return None
            return x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y

        return f"({s} {op} {t})", value

    for _ in range(12):
        source, value = made(4)
        found = [r[0] for r in df.select(compiled(source, df).number()).collect()]
        for x, (a, b) in zip(found, data, strict=True):
            wanted = value({"a": a, "b": b})
            assert x == wanted or x is not None and math.isclose(x, wanted, rel_tol=1e-9), source


def test_calculated_column(shop):
    made = calculate(shop, "total", "price / 3")
    assert [round(r.total, 11) for r in made.collect()] == [1.16666666667, 0.66666666667, 1.41666666667] and made.schema["total"].metadata["kind"] == "number"
    with pytest.raises(cleaning.StepError):
        calculate(shop, "name", "1")


# filters and sorting


def test_filters_ignore_what_is_incomplete(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("B", None, None), (None, 3.0, False)], "s string, x double, f boolean")
    assert where(df, [Filter("x", ">", "n/a"), Filter("gone", "is", "1"), Filter("x", "?", 1)]).count() == 3
    assert rows(where(df, [Filter("x", "≠", 1)]).select("x")) == [(3.0,)]
    assert rows(where(df, [Filter("s", "is not", "A")]).select("s")) == [("B",), (None,)]
    assert rows(where(df, [Filter("f", "is", "no")]).select("x")) == [(3.0,)]
    assert search(df, " b ").count() == 1 and search(df, "").count() == 3 and search(df, "YES").count() == 1


def test_natural_order(spark):
    names = ["Item 10", "item 2", "Ítem 1", "Item 002b", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "_rid long, s string")
    assert [r.s for r in sorting.sort(df, "s").collect()] == ["Ítem 1", "item 2", "Item 002b", "Item 10", None]
    assert [r.s for r in sorting.sort(df, "s", descending=True).collect()][-1] is None
    assert df.select(natural_key(F.col("s"))).count() == 5


def test_even_sample_is_exact(spark):
    for total, n in ((10, 3), (1000, 7), (50, 50), (5, 9)):
        found = [r[0] for r in sorting.even_sample(spark.range(total).withColumnRenamed("id", "_rid"), n).collect()]
        assert sorted(found) == sorted({k * total // n for k in range(n)} if n < total else range(total))


@pytest.fixture
def many_ranges(spark):
    """Ranges are not put together again, as they would be for small tables."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def test_row_numbers_and_gaps_over_many_ranges(many_ranges):
    df = many_ranges.range(0, 300_000, 3).selectExpr("(id * 7919) % 300007 as k", "if(id % 5 = 0, id, null) as v")
    keys = sorted((r.k, r.v) for r in df.collect())
    numbered = sorting.with_row_numbers(df, "k")
    assert [(r.k, r._rid) for r in numbered.select("k", "_rid").orderBy("k").collect()] == [(k, i) for i, (k, _) in enumerate(keys)]
    seen, wanted = None, []
    for k, v in keys:
        seen = v if v is not None else seen
        wanted.append((k, seen))
    assert [(r.k, r.v) for r in cleaning.fill_previous(df, "v", "k").orderBy("k").collect()] == wanted
    totals = sorting.running_totals(df.select("k", F.lit(1.0).alias("one")), [F.col("k")], "one")
    assert [r.running for r in totals.orderBy("k").collect()] == [float(i + 1) for i in range(len(keys))]


def test_running_totals(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 7 as double) as v")
    seen = 0.0
    for r in sorting.running_totals(df, [F.col("id")], "v").orderBy("id").collect():
        seen += r.v
        assert r.running == seen and r.total == sum(i % 7 for i in range(500))


# groups


def test_group_orders(spark):
    days = spark.createDataFrame([("Tue", 1), ("Mon", 9), ("(missing)", 1), ("Sun", 4)], "key string, n long")
    assert [r.key for r in summarize.ordered(days, "key", "n").orderBy("rank").collect()] == ["Mon", "Tue", "Sun", "(missing)"]
    ranges = spark.createDataFrame([("10 – 20", 1), ("2 – 10", 1), ("Other", 5)], "key string, n long")
    assert [r.key for r in summarize.ordered(ranges, "key", "n").orderBy("rank").collect()] == ["2 – 10", "10 – 20", "Other"]
    sizes = spark.createDataFrame([("b", 1), ("a", 1), ("c", 7)], "key string, n long")
    assert [r.key for r in summarize.ordered(sizes, "key", "n").orderBy("rank").collect()] == ["c", "a", "b"]


def test_group_values(spark):
    df = spark.createDataFrame([("x", 1.0, True), ("x", None, False), (None, 4.0, True), ("y", None, None)], "k string, v double, f boolean")
    made = summarize.group(df, "k", [Agg(), Agg("sum", "v"), Agg("mean", "f"), Agg("std", "v"), Agg("distinct", "v")], names=["n", "s", "m", "d", "k"])
    assert {r[0]: tuple(r)[1:] for r in made.collect()} == {"x": (2, 1.0, 0.5, None, 1), "(missing)": (1, 4.0, 1.0, None, 1), "y": (1, None, None, None, 0)}


def test_pivot_totals_are_of_the_rows(spark):
    df = spark.createDataFrame([("Mon", "am", 10.0), ("Mon", "am", 20.0), ("Mon", "pm", 60.0), ("Tue", "am", None)], "day string, shift string, sales double")
    found = {(r.row_key, r.col_key): r.value for r in summarize.pivot(df, "day", "shift", Agg("mean", "sales")).collect()}
    assert found == {("Mon", "am"): 15.0, ("Mon", "pm"): 60.0, ("Tue", "am"): None, ("Mon", None): 30.0, ("Tue", None): None, (None, "am"): 15.0, (None, "pm"): 60.0, (None, None): 30.0}
    wide, hidden = summarize.pivot_wide(df, "day", "shift", Agg("mean", "sales"), most=1)
    assert wide.columns == ["row_key", "am", "Total"] and hidden == 1


# statistics


def test_describe(spark):
    r = stats.describe(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "x double"), ["x"]).first()
    assert (r.mean, r.median, r.q1, r.q3, r.outliers) == (22.0, 3.0, 2.0, 4.0, 1) and r["skew"] > 1
    constant = stats.describe(spark.createDataFrame([(5.0,)] * 4, "x double"), ["x"]).first()
    assert constant["skew"] == 0 and constant.outliers == 0


def test_lines_and_bins(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (4.0, 9.0), (5.0, None)], "x double, y double")
    r = stats.regression(df, "x", "y").first()
    assert (r.n, round(r.slope, 9), round(r.intercept, 9), round(r.r2, 9)) == (4, 2, 1, 1)
    assert rows(stats.correlations(df.withColumn("z", F.lit(1.0)), ["x", "y", "z"])) == [("x", "y", pytest.approx(1)), ("x", "z", None), ("y", "z", None)]
    bins = stats.histogram(spark.range(101).selectExpr("cast(id as double) as x"), "x", 10).orderBy("bin").collect()
    assert [b.n for b in bins] == [10] * 9 + [11] and (bins[0].low, bins[-1].high) == (0, 100)
    assert stats.histogram(df.where("x > 9"), "x").count() == 0 and stats.histogram(df.where("x = 1"), "x").count() == 1


def test_published_probabilities():
    assert special.beta_share(2, 3, 0.5) == pytest.approx(0.6875)
    assert special.t_limit(10) == pytest.approx(2.228, abs=1e-3)
    assert special.t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.chi_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert special.f_tail(4.965, 1, 10) == pytest.approx(0.05, abs=1e-3)


def test_tests_of_columns(spark):
    groups = spark.createDataFrame([(g, float(v)) for g, vs in (("a", (1, 2, 3)), ("b", (2, 3, 4)), ("c", (9, 10, 11))) for v in vs], "g string, v double")
    found = significance.test_columns(groups, "g", "v")
    assert isinstance(found, significance.Anova) and found.f == pytest.approx(57) and found.p < 0.001
    two = significance.test_columns(groups.where("g != 'c'"), "v", "g")
    assert isinstance(two, significance.Welch) and two.diff in (-1.0, 1.0)
    cells = [("y", "u")] * 30 + [("y", "w")] * 10 + [("n", "u")] * 10 + [("n", "w")] * 30
    chi = significance.test_columns(spark.createDataFrame(cells, "a string, b string"), "a", "b")
    assert chi.chi2 == pytest.approx(20) and chi.df == 1 and chi.v == pytest.approx(0.5)
    assert significance.correlation(groups.withColumn("w", 2 * F.col("v")), "v", "w").p == 0


# cleaning


def test_repeats_and_gaps(spark):
    df = spark.createDataFrame([(0, "A ", 1.0), (1, "a", None), (2, None, 3.0), (3, "A ", 1.0)], "_rid long, s string, v double")
    assert [r._rid for r in cleaning.remove_duplicates(df).orderBy("_rid").collect()] == [0, 1, 2]
    assert [r._rid for r in cleaning.remove_duplicates(df, ["s"]).orderBy("_rid").collect()] == [0, 2]
    assert cleaning.count_duplicates(df.drop("_rid"), ["s"]).first()[0] == 2
    assert [r.v for r in cleaning.fill_previous(df, "v").orderBy("_rid").collect()] == [1.0, 1.0, 3.0, 1.0]
    assert [r.v for r in cleaning.fill(df, "v", "median").orderBy("_rid").collect()] == [1.0, 1.0, 3.0, 1.0]
    assert [r.s for r in cleaning.fill(df, "s", "mode").orderBy("_rid").collect()] == ["A ", "a", "A ", "A "]
    for method, value in (("mean", None), ("value", " "), ("value", "x")):
        with pytest.raises(cleaning.StepError):
            cleaning.fill(df, "s" if method == "mean" else "v", method, value)
    assert cleaning.drop_missing(df.drop("_rid")).count() == 2


def test_texts(spark):
    df = spark.createDataFrame([("  SAN-josé  new_york ",), ("a.b$c",)], "s string")
    assert [r.s for r in cleaning.change_text(df, "s", "trim").collect()] == ["SAN-josé new_york", "a.b$c"]
    assert cleaning.change_text(df, "s", "title").first().s == "  San-José  New_York "
    assert [r.s for r in cleaning.replace(df, "s", ".B$", "$1\\").collect()][1] == "a$1\\c"
    assert [r.s for r in cleaning.replace(df, "s", "A.B$C", "z", whole=True).collect()][1] == "z"
    parts = cleaning.split(spark.createDataFrame([("a, b, c", 1), ("d", 2), (None, 3)], "place string, n int"), "place", ",")
    assert parts.columns == ["place", "place 1", "place 2", "place 3", "n"] and rows(parts)[:2] == [("a, b, c", "a", "b", "c", 1), ("d", "d", None, None, 2)]


def test_bins_tops_and_dates(spark):
    df = spark.createDataFrame([(3.0, "x"), (27.0, "x"), (60.0, "y"), (None, None)], "age double, fruit string")
    assert [r[-1] for r in rows(cleaning.group_ranges(df, "age", "range", 20))] == ["0 – 20", "20 – 40", "60 – 80", None]
    assert cleaning.nice_bin(3, 60) == 10
    assert [r[-1] for r in rows(cleaning.group_top(df, "fruit", "top", 1))] == ["x", "x", "Other", None]


def test_long_and_wide(spark):
    df = spark.createDataFrame([("A", 1.0, None), ("B", 3.0, 4.0)], "shop string, Jan double, Feb double")
    long = cleaning.unpivot(df, ["Jan", "Feb"], "month", "sales")
    assert rows(long) == [("A", "Jan", 1.0), ("A", "Feb", None), ("B", "Jan", 3.0), ("B", "Feb", 4.0)]
    back = cleaning.widen(long, "month", "sales")
    assert {tuple(r) for r in back.select("shop", "Jan", "Feb").collect()} == {tuple(r) for r in df.collect()}


def test_recipe_and_its_file(spark):
    df = spark.createDataFrame([(0, " a ", 5.0), (1, "a", None)], "_rid long, s string, v double")
    steps = [{"op": "text", "column": "s", "how": "trim"}, {"op": "fillMissing", "column": "v", "method": "previous"}, {"op": "formula", "name": "w", "formula": "v * 2"}, {"op": "join", "other": df, "leftKey": "s", "rightKey": "s"}]
    text, left_out = recipe.to_json(steps)
    assert left_out == 1 and recipe.from_json(text) == steps[:3]
    assert [(r.s, r.v, r.w) for r in recipe.replay(df, steps[:3]).orderBy("_rid").collect()] == [("a", 5.0, 10.0), ("a", 5.0, 10.0)]
    kept, failed = recipe.replay_longest(df, [*steps[:3], {"op": "nothing"}, {"op": "rename", "column": "w", "name": "z"}])
    assert "z" in kept.columns and failed == [{"op": "nothing"}]
    assert recipe.needed_columns(steps[:3]) == {"s", "v"}


# joins


def test_join_kinds_and_preview(spark):
    a = spark.createDataFrame([(1, "007", 5.0), (2, "7.0", 6.0), (3, "C1", 7.0), (4, None, 8.0)], "n int, customer string, total double")
    b = spark.createDataFrame([("7", "Oslo", 1), ("c1 ", "Rome", 2), ("c9", "Bonn", 3), ("", "none", 4)], "id string, city string, n int")
    for how, count in (("left", 4), ("inner", 3), ("full", 6)):
        made = combine.join(a, b, "customer", "id", how, "cities")
        assert made.count() == count and "n (cities)" in made.columns
        p = combine.preview(a, b, "customer", "id").first()
        assert {"left": p.left_result_rows, "inner": p.inner_rows, "full": p.full_rows}[how] == count
    assert {r.customer for r in combine.join(a, b, "customer", "id", "full").collect()} == {"007", "7.0", "C1", None, "c9"}
    assert combine.suggest_keys(a.drop("n"), b.drop("n"))[0][:2] == ("customer", "id")
    assert [r[0] for r in spark.createDataFrame([("1,000",), ("12345678901234567",), ("x",)], "k string").select(join_key(spark.createDataFrame([("",)], "k string"), "k")).collect()] == ["#1000.0", "12345678901234567", "x"]


def test_append_by_name(spark):
    a, b = spark.createDataFrame([("x", 1)], "Product string, amount int"), spark.createDataFrame([(2, "y", "s")], "Amount int, ` product` string, store string")
    made = combine.append(a, b, "source", "one", "two")
    assert made.columns == ["Product", "amount", "source", "store"] and sorted(rows(made), key=repr) == [("x", 1, "one", None), ("y", 2, "two", "s")]


# series


@pytest.fixture(scope="module")
def visits(spark):
    """70 days, busy weekends, one spike."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    busy = F.when(F.dayofweek(day).isin(1, 7), 200.0).otherwise(100.0) + F.col("id") % 5
    return spark.range(70).select(day.cast("timestamp").alias("date"), F.when(F.col("id") == 30, 900.0).otherwise(busy).alias("sales"))


def test_only_the_spike_is_unusual(visits):
    found = series.unusual(visits, "date", "sales").collect()
    assert [str(r["at"])[:10] for r in found] == ["2024-01-31"] and found[0].score > 3.5


def test_few_points_are_refused(visits):
    with pytest.raises(ValueError, match="at least 10"):
        series.unusual(visits, "date", "sales", "month")


def test_gaps_lie_on_the_line(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-04", 7.0), ("2024-01-05", 2.0)], "d string, y double").select(F.col("d").cast("timestamp_ntz").alias("at"), "y")
    assert [(r.y, r.filled) for r in series.regular(df, "day").orderBy("at").collect()] == [(1.0, False), (3.0, True), (5.0, True), (7.0, False), (2.0, False)]


def plain_fit(y, cycle):
    """One setting after another, one point after another."""
    best = None
    for a in forecast.ALPHAS:
        for b in forecast.BETAS:
            for p in forecast.PHIS:
                for g in forecast.GAMMAS if cycle else (0.0,):
                    if cycle:
                        level, trend, season = np.mean(y[:cycle]), (np.mean(y[cycle : 2 * cycle]) - np.mean(y[:cycle])) / cycle, list(y[:cycle] - np.mean(y[:cycle]))
                    else:
                        level, trend, season = y[0], y[1] - y[0], []
                    total = 0.0
                    for t in range(cycle or 1, len(y)):
                        s = season[t - cycle] if cycle else 0.0
                        total += (y[t] - level - p * trend - s) ** 2
                        old = level
                        level = a * (y[t] - s) + (1 - a) * (level + p * trend)
                        trend = b * (level - old) + (1 - b) * p * trend
                        if cycle:
                            season.append(g * (y[t] - level) + (1 - g) * s)
                    if best is None or total < best[0]:
                        best = (total, level, trend, season[len(season) - cycle :], p)
    return best


@pytest.mark.parametrize("cycle", [0, 7])
def test_forecast_against_plain_loop(cycle):
    rng = np.random.default_rng(cycle)
    y = 50 + np.arange(60) * 0.7 + (np.tile([0, 3, 6, 2, 1, -9, -8], 9)[:60] if cycle else 0) + rng.normal(0, 1, 60)
    total, level, trend, season, phi = plain_fit(y, cycle)
    value, _ = forecast.fit(y, cycle).ahead(10)
    damp = 0.0
    for h in range(10):
        damp += phi ** (h + 1)
        assert value[h] == pytest.approx(level + damp * trend + (season[h % cycle] if cycle else 0.0))


def test_forecast_covers_and_stays_positive():
    rng = np.random.default_rng(1)
    inside = 0
    for _ in range(30):
        y = 100 + np.arange(140) * 0.5 + np.tile([0, 5, 9, 4, 2, -12, -8], 20) + rng.normal(0, 3, 140)
        f = forecast.forecast(y[:-7], "day", 7)
        inside += ((y[-7:] >= f.low) & (y[-7:] <= f.high)).sum()
        assert f.cycle == 7 and f.share < 0.2
    assert inside / 210 > 0.6
    assert (forecast.forecast(np.linspace(50, 1, 30), "month", 12).low >= 0).all()


# analyses


def test_change_is_due_to_north(spark):
    data = [(f"2024-0{m}-05", r, c, v / 2) for m, rs in ((1, {"North": 100.0, "South": 50.0, "West": 50.0}), (2, {"North": 40.0, "South": 55.0, "West": 50.0})) for r, v in rs.items() for c in ("web", "shop")]
    df = spark.createDataFrame(data, "d string, region string, channel string, revenue double").withColumn("date", F.to_timestamp("d")).drop("d")
    found = analyses.explain_change(df, "date", "revenue", unit="month").orderBy(F.desc("score"), F.abs("change").desc()).first()
    assert (found.by, found.label, found.change) == ("region", "North", -60.0)
    with pytest.raises(ValueError, match="only one"):
        analyses.explain_change(df, "date", "revenue", unit="year")


def test_groups_differ_in_customers_and_simpson(spark):
    data = [(i % 2 == 0, 100.0 + 30 * (i % 2 == 0) + i % 5, 20.0 + i % 3) for i in range(40)]
    found = analyses.group_differences(spark.createDataFrame(data, "weekend boolean, customers double, temp double"), "weekend", "Yes", "No")
    assert found[0].column == "customers" and found[0].test.p < 0.001
    cases = [("a", "easy", 0.93, 9), ("b", "easy", 0.87, 27), ("a", "hard", 0.73, 26), ("b", "hard", 0.69, 8)]
    df = spark.createDataFrame([(t, d, v) for t, d, v, n in cases for _ in range(n)], "treatment string, difficulty string, recovery double")
    assert analyses.reversals(df, "treatment", "a", "b", "recovery", ["difficulty"]) == ["difficulty"]


def test_cohorts_and_funnel(spark):
    visits = [("a", "2024-01-03"), ("a", "2024-02-01"), ("b", "2024-01-09"), ("c", "2024-01-20"), ("c", "2024-03-02"), ("d", "2024-01-30"), ("d", "2024-02-11"), ("e", "2024-03-15")]
    df = spark.createDataFrame(visits, "id string, d string").withColumn("date", F.to_timestamp("d"))
    found = {(r.cohort, r.later): r.rate for r in analyses.cohorts(df, "id", "date", 2).collect()}
    assert found == {("2024-01", 1): 0.5, ("2024-01", 2): 0.25, ("2024-03", 1): None, ("2024-03", 2): None}
    people = spark.createDataFrame([(i < 90, i < 30, i < 12, i % 2 == 0) for i in range(100)], "visited boolean, signed_up boolean, bought boolean, rainy boolean")
    steps = analyses.nested_steps(people)
    assert steps == ["visited", "signed_up", "bought"] and [r.n for r in analyses.funnel(people, steps).orderBy("step").collect()] == [100, 90, 30, 12]


def test_trend_pattern_and_delay(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    df = spark.range(180).select(day.cast("timestamp").alias("date"), (100 + F.col("id") + F.when(F.dayofweek(day) == 7, 80.0).otherwise(0.0)).alias("sales"), ((F.col("id") * 37) % 11).cast("double").alias("rain"))
    assert analyses.trend(df, "date", "sales").first().share > 0.01
    assert analyses.pattern(df, "date", "sales", "weekday").orderBy(F.desc("effect")).first().slot == 5
    later = df.withColumn("busy", -F.lag("rain").over(__import__("pyspark").sql.Window.orderBy("date")))
    lags = {r.lag: r.r for r in analyses.delayed(later, "date", "rain", "busy").collect()}
    assert lags[1] == pytest.approx(-1) and len(lags) == 8 and all(abs(v) < 0.9 for k, v in lags.items() if k != 1)


def test_what_if(spark):
    data = [(20.0 + i % 10, i % 7 < 2, ("a", "b", "c")[i % 3], 50 + 4 * (20 + i % 10) + 30 * (i % 7 < 2) + 5 * (i % 3 == 1)) for i in range(80)]
    df = spark.createDataFrame([(t, w, a, float(c)) for t, w, a, c in data], "temp double, weekend boolean, area string, customers double")
    m = analyses.what_if(df, "customers")
    assert m.r2 > 0.98 and m.coefficients[1 + m.numbers.index("temp")] == pytest.approx(4, abs=0.1)
    value, low, high = m.predict({"temp": 25, "weekend": True, "area": "b"})
    assert value == pytest.approx(50 + 100 + 35, abs=1) and low <= value <= high
    assert df.select(F.max(F.abs(m.column(df) - F.col("customers")))).first()[0] < 1
    with pytest.raises(ValueError, match="at least 15"):
        analyses.what_if(df.limit(5), "customers", ["temp"])


def test_natural_groups(spark):
    data = [(i, 10.0 + i % 3, 1.0) if i < 40 else (i, 90.0 + i % 3, 9.0) for i in range(60)] + [(60, None, 3.0), (61, None, None)]
    made, k = analyses.natural_groups(spark.createDataFrame(data, "id int, spend double, visits double"), ["spend", "visits"])
    sizes = {r.segment: r["count"] for r in made.groupBy("segment").count().collect()}
    assert k == 2 and sizes == {1: 41, 2: 20, None: 1}  # one of two values is enough, the other is the median


def test_tone_takes_the_words_of_a_text_once(spark):
    long = " ".join(["not so good"] * 3 + ["word"] * 4000 + ["great"] * 4)
    made = spark.createDataFrame([(long,)], "t string").select(texts.tone(F.col("t")).alias("tone"))
    assert made.first().tone == 1
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1


def test_natural_groups_that_take_turns(spark):
    """Three clouds by the row number modulo 6: a sample of every sixth row would see one of them only."""
    cloud = lambda *v: F.when(F.col("id") % 6 < 3, v[0]).when(F.col("id") % 6 < 5, v[1]).otherwise(v[2])
    df = spark.range(18000).select("id", (cloud(0, 100, 200) + F.col("id") % 50 / 10).alias("x"), (cloud(300, 0, 150) + F.col("id") % 7 / 10).alias("y"))
    made, k = analyses.natural_groups(df, ["x", "y"], order=["id"])
    assert k == 3 and made.where(cloud(1, 2, 3) != F.col("segment")).count() == 0


@pytest.mark.parametrize(("total", "n"), [(0, 5), (4, 5), (5, 5), (6, 5), (1000, 7), (18000, 3000), (9999, 1000)])
def test_scattered_sample_is_exact(spark, total, n):
    found = sorted(r[0] for r in sorting.scattered_sample(spark.range(total).withColumnRenamed("id", "_rid"), n).collect())
    if total <= n:
        assert found == list(range(total))
    else:
        assert len(found) == n and all(k * total // n <= r < (k + 1) * total // n for k, r in enumerate(found))


def test_tone_and_stems(spark):
    tones = [("not good at all", -1), ("good, but not bad", 1), ("", 0), (None, 0), ("Never a problem", 0), ("great!", 1)]
    df = spark.createDataFrame([(t,) for t, _ in tones], "t string")
    assert [r[0] for r in df.select(texts.tone(F.col("t"))).collect()] == [w for _, w in tones]
    stems = {"prices": "pric", "pricing": "pric", "price": "pric", "parties": "party", "slow": "slow", "stopped": "stop", "friendly": "friend"}
    df = spark.createDataFrame([(w,) for w in stems], "w string")
    assert [r[0] for r in df.select(texts.stem(F.col("w"))).collect()] == list(stems.values())


# insights


def test_health_and_its_fixes(spark):
    data = [("CA", 1.0, "x", None, "k"), ("ca", 2.0, " y", None, "k"), ("CA", None, "z", None, "k"), ("CA", 1.0, "x", None, "k"), ("NY", 4.0, "w  w", None, "k")]
    df = spark.createDataFrame(data, "state string, amount double, notes string, blank string, same string")
    found = insights.health(df)
    assert {(i.kind, i.column) for i in found} == {("duplicates", None), ("empty", "blank"), ("missing", "amount"), ("variants", "state"), ("spaces", "notes"), ("constant", "same")}
    assert found[0].severity == "high" and insights.score(found) == 100 - 15 - 8 - 8 - 3 - 3 - 3
    numbered = df.withColumn("_rid", F.monotonically_increasing_id())
    fixed = recipe.replay(numbered, [i.fix for i in found if i.safe])
    assert not {i.kind for i in insights.health(fixed)} & {"duplicates", "empty", "variants", "spaces"}
    assert insights.health(df.limit(0)) == []


def test_texts_that_are_numbers(spark):
    df = spark.createDataFrame([(str(i),) for i in range(19)] + [("n/a?",)], "amount string")
    assert [(i.kind, i.fix["type"]) for i in insights.health(df) if i.kind == "type"] == [("type", "number")]


def test_drivers_and_facts(spark):
    data = [(f"s{i}", float(i % 10), ("x", "y")[i % 2], 2.0 * (i % 10) + (i % 2), i % 10 > 4) for i in range(60)]
    df = spark.createDataFrame(data, "student string, hours double, major string, score double, passed boolean")
    found = insights.drivers(df, "score")
    assert found[0].column == "hours" and "student" not in {d.column for d in found} and found[0].strength > 0.98
    assert insights.drivers(df, "passed")[0].column in ("hours", "score")
    facts = insights.facts(df)
    assert facts[0].kind == "correlation" and set(facts[0].columns) == {"hours", "score"}


def test_story(spark):
    df = spark.createDataFrame([(float(i % 10), 2.0 * (i % 10), "x" if i % 20 else "y") for i in range(60)], "hours double, score double, kind string")
    told = insights.story(df, "score")
    assert told[0] == "The table has 60 rows and 3 columns." and "hours explains most of score: 100% of its variation." in told
    assert "hours and score tend to rise together (r = 1.00)." in told and "95% of the rows have the same kind." in told
    assert insights.sentence(insights.Fact("outliers", ("a",), 0.004)).startswith("Under 1%")


def test_project(spark, tmp_path):
    df = spark.createDataFrame([("a ", 1.0), ("b", None)], "k string, v double")
    steps = [{"op": "text", "column": "k", "how": "trim"}, {"op": "rename", "column": "gone", "name": "x"}, {"op": "fillMissing", "column": "v", "method": "mean"}, {"op": "append", "other": df}]
    questions = [{"result": {"kind": "value"}}]
    assert projects.save_project(df, steps, str(tmp_path / "p"), questions) == 1
    original, made, failed, asked = projects.load_project(spark, str(tmp_path / "p"))
    assert sorted(rows(original), key=repr) == sorted(rows(df), key=repr) and asked == questions
    assert sorted(rows(made)) == [("a", 1.0), ("b", 1.0)] and [s["op"] for s in failed] == ["rename"]
    assert recipe.missing_for(df, steps) == ["gone"]


# charts


def test_chart_data(spark):
    df = spark.createDataFrame([(f"k{i % 9}", float(i), i % 3 == 0) for i in range(90)], "k string, v double, f boolean")
    assert {r.colour for r in charts.stacked(df, "f", "k", "v").collect()} == {f"k{i}" for i in range(6)} | {"Other"}
    bars = charts.bars(df, "k").orderBy("rank").collect()
    assert len(bars) == 9 and bars[0].value == 10
    box = charts.boxes(df, "f", "v").where("label = 'yes'").first()
    assert box.n == 30 and box.whisker_high == 87 and box.outliers == 0
    days = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-04", 2.0)], "d string, v double").withColumn("d", F.to_timestamp("d"))
    assert [r.value for r in charts.calendar(days, "d", "v").orderBy("day").collect()] == [1.0, None, None, 2.0]
    assert charts.line(days, "d", "v").count() == 2


def test_number_text(spark):
    values = {0.1 + 0.2: "0.3", 1234567.0: "1234567", -2.5: "-2.5", 1e15: "1000000000000000", 0.0: "0"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(number_text(F.col("v"))).collect()] == list(values.values())


# profiles, stored questions, sentences


def test_default_columns_and_profiles(spark):
    data = [(i, f"c{i % 6}", float(i % 9), 5.0, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(data, "order_id long, customer string, revenue double, price double, paid boolean")
    assert profile.default_measure(df) == "revenue" and profile.default_measure(df.drop("revenue")) == "price" and profile.default_measure(df.select("order_id")) is None
    assert profile.id_columns(df) == ["customer"]
    assert profile.profile(df, "customer")["values"][0] == ("c0", 10) and profile.profile(df, "revenue")["median"] == 4
    assert [profile.suggest_chart(df, *xs) for xs in (("revenue",), ("revenue", "price"), ("customer",), ("customer", "price"))] == ["histogram", "scatter", "bar", "box"]
    assert [tuple(r) for r in profile.overview(df).collect()][1] == ("customer", "category", 0, 6)
    money = spark.createDataFrame([("$1",), ("$2",), ("3",), ("$4",), ("$5",)], "v string")
    assert profile.unit_of(money, "v") == "$"


def test_stored_questions(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, False), ("b", 10.0, True)], "k string, v double, f boolean")
    found = answers.report(df, [{"result": {"kind": "value", "agg": "sum", "column": "v"}}, {"result": {"kind": "value", "agg": "sum", "column": "gone"}}, {"result": {"kind": "drivers", "target": "v"}}], [Filter("f", "is", "yes")])
    assert found[0].first().value == 11.0 and found[1] == "Missing columns: gone" and found[2].columns[0] == "column_name"
    assert answers.tile_columns(df) == ["k", "f"]
    summary = answers.answer(df, {"result": {"kind": "summary", "by": "k", "agg": "mean", "column": "v"}})
    assert [(r.key, r.value, r["rank"]) for r in summary.collect()] == [("a", 2.0, 1), ("b", 10.0, 2)]
    with pytest.raises(ValueError, match="Unknown kind"):
        answers.answer(df, {"result": {"kind": "song"}})


def test_values_as_read():
    import datetime as dt

    shown = [(1234.567, "1,234.6"), (12.345, "12.35"), (0.12345, "0.1235"), (-0.00001, "-1.000e-05"), (100.0, "100"), (1e16, "1.000e+16"), (None, "")]
    assert [formatting.number(x) for x, _ in shown] == [w for _, w in shown]
    assert formatting.value(True) == "yes" and formatting.date(dt.datetime(2024, 3, 5)) == "Mar 5, 2024" and formatting.date(dt.datetime(2024, 3, 5, 9, 7)) == "Mar 5, 2024 09:07"
    assert significance.verdict(0.01) == "likely real" and significance.verdict(None).startswith("not enough") and significance.effect_size(-0.6) == "a clear difference" and significance.p_words(0.0001) == "p < 0.001"


def test_sentences_and_new_names():
    step = {"op": "keepRows", "filters": [{"column": "a", "op": ">", "value": "1"}, {"column": "b", "op": "is missing"}]}
    assert recipe.described(step) == "Keep rows that match a > 1 and b is missing"
    assert recipe.described({"op": "unpivot", "columns": ["x", "y"], "names": "n", "values": "v"}) == "Turn x, y into rows"
    assert set(recipe.SENTENCES) == set(recipe.STEPS)
    assert recipe.renamed(step, "a", "z")["filters"][0]["column"] == "z" and recipe.renamed({"op": "unpivot", "columns": ["a", "b"], "names": "a", "values": "v"}, "a", "z") == {"op": "unpivot", "columns": ["z", "b"], "names": "a", "values": "v"}


def test_anova_of_many_groups(spark):
    from gristmill.operators import significance

    k = 12_000
    df = spark.range(2 * k).selectExpr("concat('g', id % 12000) AS g", "CAST(id % 12000 + IF(id < 12000, 0, 1) AS double) AS x")
    found = significance.anova(df, "g", "x")
    assert (found.df1, found.df2) == (k - 1, k)
    between, within = 2 * sum((i - (k - 1) / 2) ** 2 for i in range(k)), 0.5 * k
    assert abs(found.f / (between / (k - 1) / (within / k)) - 1) < 1e-9


def test_usable_groups_are_found_among_many_single_ones(spark):
    from gristmill.operators import significance

    df = spark.range(20_060).selectExpr("IF(id < 20000, concat('s', id), concat('g', id % 3)) AS g", "CAST(id % 7 AS double) AS x")
    found = significance.test_columns(df, "g", "x")
    assert isinstance(found, significance.Anova) and (found.df1, found.df2) == (2, 57)


# notes, tables of charts, fields of forms, analyses that fit


def test_notes_and_tables_of_charts(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, "a"), ("2024-01-02", 2.5, "b"), ("2024-01-04", None, "a")], "d string, v double, k string").withColumn("d", F.to_timestamp("d"))
    notes = [{"date": "2024-01-02", "text": "sale"}, {"date": "soon", "text": "x"}, {"date": "2024-01-03", "text": ""}]
    assert [(str(at)[:10], t) for at, t in charts.notes_on(df, "d", notes)] == [("2024-01-02", "sale")] and charts.notes_on(df, "k", notes) == []
    assert [tuple(r) for r in charts.as_table(charts.line(df, "d", "v", unit="day"), "line").collect()] == [("2024-01-01", "1"), ("2024-01-02", "2.5")]
    assert [tuple(r) for r in charts.as_table(charts.bars(df, "k", "v", "sum"), "bar").collect()] == [("b", "2.5"), ("a", "1")]
    assert [tuple(r) for r in charts.as_table(charts.calendar(df, "d", "v"), "calendar").collect()] == [("2024-01-01", "1"), ("2024-01-02", "2.5"), ("2024-01-04", "0")]
    assert charts.as_table(charts.boxes(df, "k", "v"), "box").count() == 2
    with pytest.raises(ValueError, match="pie"):
        charts.as_table(df, "pie")


def test_field_summary(spark):
    rows = [(1, '{"r": 4, "c": ["tea", "milk"], "y": true, "t": "first"}'), (2, '{"r": 5, "c": [], "t": "second"}'), (3, '{"c": ["tea"], "y": false}'), (4, '{"t": "third"}'), (5, '{"t": "last"}')]
    df = spark.createDataFrame(rows, "received int, values string")
    rating = profile.field_summary(df, {"id": "r", "type": "rating"})
    assert rating == {"answered": 2, "total": 5, "mean": 4.5, "min": 4.0, "max": 5.0, "counts": [("1", 0), ("2", 0), ("3", 0), ("4", 1), ("5", 1)]}
    assert profile.field_summary(df, {"id": "c", "type": "checkboxes", "options": ["tea", "milk", "water"]})["counts"] == [("tea", 2), ("milk", 1), ("water", 0)]
    assert profile.field_summary(df, {"id": "y", "type": "yesno"})["counts"] == [("Yes", 1), ("No", 1)]
    assert profile.field_summary(df, {"id": "t", "type": "paragraph"})["latest"] == ["last", "third", "second"]


def test_applicable(spark):
    df = spark.createDataFrame([(f"2024-01-{1 + i % 28:02d}", float(i), "ab"[i % 2], i % 2 == 0) for i in range(40)], "d string, v double, k string, f boolean").withColumn("d", F.to_timestamp("d"))
    found = profile.applicable(df)
    assert found["change"] is None and found["compare"] is None and found["whatif"] is None and found["groups"] == "needs two or more number columns"
    assert found["themes"] == "needs a column of written answers" and found["returns"].startswith("needs a customer")


def test_renames_reach_stored_questions():
    spec = {"filters": [{"column": "a", "op": "is", "value": "a"}], "result": {"kind": "summary", "by": "a", "column": "b"}}
    assert answers.renamed(spec, "a", "z") == {"filters": [{"column": "z", "op": "is", "value": "a"}], "result": {"kind": "summary", "by": "z", "column": "b"}}


def test_quantiles_of_groups(spark):
    from gristmill.operators.quantiles import of_columns, quantiles

    rnd = np.random.default_rng(8)
    rows = [(("a", "b", None)[int(k)], float(v) if v < 90 else None) for k, v in zip(rnd.integers(0, 3, 400), rnd.integers(0, 100, 400), strict=True)] + [("c", None), ("d", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: r.q for r in quantiles(df, ["k"], F.col("v"), (0.1, 0.5, 0.75)).collect()}
    assert set(found) == {"a", "b", None, "d"}
    for k, q in found.items():
        assert np.allclose(q, np.quantile([v for g, v in rows if g == k and v is not None], (0.1, 0.5, 0.75)))
    whole = np.quantile([v for _, v in rows if v is not None], (0.25, 0.5, 0.75))
    assert np.allclose(of_columns(df, {"v": F.col("v"), "w": F.col("v") * 2, "none": F.lit(None)})["w"], 2 * whole)


def test_spellings_are_merged_by_a_join(spark):
    from gristmill.operators.insights import merge_spellings

    df = spark.createDataFrame([("New  York",), ("new york",), ("New York",), ("New York",), ("Rome",), (None,)], "city string")
    assert sorted((r.city or "") for r in merge_spellings(df, "city").collect()) == ["", "New York", "New York", "New York", "New York", "Rome"]


def test_join_keys_are_scored_by_the_right_side(spark):
    left = spark.createDataFrame([(i, i % 2, "x") for i in range(20)], "id int, two int, one string")
    right = spark.createDataFrame([(i, "x") for i in range(10, 30)], "ID int, one string")
    assert combine.suggest_keys(left, right)[0] == ("id", "ID", 0.5 + 1 + 0.25)
    assert not any(a == "one" for a, _, _ in combine.suggest_keys(left, right))


def test_formulas_refuse_keywords(spark):
    from gristmill.functions.formula import FormulaError, calculate

    df = spark.createDataFrame([(5.0,)], "x double")
    for source in ("max(1, ^x)", "max(1, *x)", "max(a = x)", "max(1, **x)"):
        with pytest.raises(FormulaError):
            calculate(df, "y", source)
    assert calculate(df, "y", "max(1, x ^ 2)").first().y == 25
