"""Answers to practical questions: why a total changed, how groups differ, who comes back, where people drop off.

Each is one or two aggregations over the table; what comes to the driver are column names, group sizes or a small matrix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.values import kind_of
from . import distinct, groups
from .quantiles import of_columns
from .series import DAYS_A_YEAR, period_unit, start_of, totals
from .significance import Welch, welch_from
from .stats import num, pearson
from .summarize import MISSING, UNITS, number

MOST_GROUPS, WIDE = 60, 15
#: Half-width of an 80 % interval in standard deviations.
Z80 = 1.2816


def labels(df: DataFrame, name: str) -> Column:
    """Values as labels; yes/no columns have Yes and No, missing ones their own label."""
    c = F.col(f"`{name}`")
    text = F.when(c, "Yes").when(~c, "No") if kind_of(df, name) == "boolean" else c.cast("string")
    return F.coalesce(text, F.lit(MISSING))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact numbers of distinct values of all columns."""
    return {c: n.values for c, n in distinct.exact(df, columns).items()}


def grouping_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Label and yes/no columns of 2 to 60 values; columns of more are not counted on."""
    names = [c for c in df.columns if c not in exclude and kind_of(df, c) in ("category", "text", "boolean")]
    counts = distinct.bounded(df, names, MOST_GROUPS)
    return [c for c in names if 2 <= counts[c].values <= MOST_GROUPS]


def long_labels(df: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """A row per row and column of ``columns``: by, label and ``keep``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("by"), labels(df, c).alias("label")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_pair")).select("*", "_pair.*").drop("_pair")


def two_periods(df: DataFrame, date: str, unit: str) -> tuple[str, str]:
    """The last period of the table and the one before it."""
    label = F.date_format(F.col(f"`{date}`"), UNITS[unit]).alias("p")
    found = [r.p for r in df.where(F.col(f"`{date}`").isNotNull()).select(label).distinct().orderBy(F.desc("p")).limit(2).collect()]
    if len(found) < 2:
        raise ValueError(f"There is only one {unit} in the data, so there is nothing to compare.")
    return found[1], found[0]


def explain_change(
    df: DataFrame, date: str, measure: str | None, by: Sequence[str] | None = None, periods: tuple[str, str] | None = None, unit: str | None = None
) -> DataFrame:
    """(by, label, before, after, change, score): what each label of each column adds to the change between two periods.

    ``score`` of a column is the share of its three largest changes in the sum of all, less a tenth for more than 15
    labels: the column with the highest has the clearest cause. All columns are summed in one job.
    """
    unit = unit or period_unit(df, date)
    first, last = periods or two_periods(df, date, unit)
    period = F.date_format(F.col(f"`{date}`"), UNITS[unit])
    held = df.where(period.isin(first, last))
    by = list(by) if by is not None else grouping_columns(held, [date, *([measure] if measure else [])])
    value = F.coalesce(number(df, measure), F.lit(0.0)) if measure else F.lit(1.0)
    rows = long_labels(held, by, (period == last).alias("late"), value.alias("v"))
    part = lambda late: F.sum(F.when(F.col("late") == late, F.col("v")).otherwise(0.0))
    made = rows.groupBy("by", "label").agg(part(False).alias("before"), part(True).alias("after"))
    parts = made.withColumn("change", F.col("after") - F.col("before"))
    size, over = F.abs("change"), W.partitionBy("by")
    rank = F.row_number().over(over.orderBy(F.abs("change").desc(), "label"))
    top = F.sum(F.when(F.col("_rank") <= 3, size)).over(over)
    wide = F.when(F.count("*").over(over) > WIDE, 0.1).otherwise(0.0)
    score = F.when(F.sum(size).over(over) > 0, top / F.sum(size).over(over) - wide).otherwise(0.0)
    return parts.withColumn("_rank", rank).withColumn("score", score).drop("_rank")


@dataclass(frozen=True)
class Difference:
    column: str
    mean1: float
    mean2: float
    share: float | None
    d: float
    test: Welch


def group_differences(df: DataFrame, split: str, first: str, second: str, columns: Sequence[str] | None = None) -> list[Difference]:
    """Number columns by how far two groups differ in them, in pooled standard deviations; one job for all columns."""
    columns = [c for c in (columns or df.columns) if kind_of(df, c) == "number"]
    held = df.withColumn("_g", labels(df, split)).where(F.col("_g").isin(first, second))
    moments = [F.struct(F.count(num(c)), F.avg(num(c)), F.coalesce(F.var_samp(num(c)), F.lit(0.0))).alias(f"m{i}") for i, c in enumerate(columns)]
    found = {r["_g"]: r for r in held.groupBy("_g").agg(*moments).collect()} if columns else {}
    out = []
    for i, c in enumerate(columns):
        if len(found) < 2:
            break
        (n1, m1, v1), (n2, m2, v2) = tuple(found[first][f"m{i}"]), tuple(found[second][f"m{i}"])
        if n1 < 2 or n2 < 2:
            continue
        pooled = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
        test = welch_from((n1, m1, v1), (n2, m2, v2))
        out.append(Difference(c, m1, m2, (m1 - m2) / abs(m2) if m2 else None, (m1 - m2) / pooled if pooled else 0.0, test))
    return sorted(out, key=lambda x: -abs(x.d))


def reversals(df: DataFrame, split: str, first: str, second: str, measure: str, others: Sequence[str]) -> list[str]:
    """Columns within whose every level the difference of the two groups points the other way than overall.

    They need 2 to 8 levels and at least two with five values of either group.
    """
    rows = long_labels(df.where(F.col(f"`{measure}`").isNotNull()), list(others), labels(df, split).alias("g"), num(measure).alias("x"))
    side = lambda f, g: f(F.when(F.col("g") == g, F.col("x")))
    level = rows.where(F.col("label") != MISSING).groupBy("by", "label").agg(
        (side(F.avg, first) - side(F.avg, second)).alias("diff"), side(F.count, first).alias("n1"), side(F.count, second).alias("n2")
    )
    big = (F.col("n1") >= 5) & (F.col("n2") >= 5)
    whole = df.agg(*[F.avg(F.when(labels(df, split) == g, num(measure))) for g in (first, second)]).first()
    if None in whole or whole[0] == whole[1]:
        return []
    sign = 1 if whole[0] > whole[1] else -1
    judged = level.groupBy("by").agg(F.count("*").alias("levels"), F.count_if(big).alias("usable"), F.count_if(big & (F.signum("diff") != -sign)).alias("same"))
    return [r.by for r in judged.where("levels BETWEEN 2 AND 8 AND usable >= 2 AND same = 0").orderBy("by").collect()]


def cohorts(df: DataFrame, person: str, date: str, months: int = 6) -> DataFrame:
    """(cohort, size, later, back, rate): of those first seen in a month, how many are there again so many months later.

    ``rate`` is null for months after the last one of the table.
    """
    month = (F.year(F.col(f"`{date}`")) * 12 + F.month(F.col(f"`{date}`")) - 1).alias("m")
    seen = df.where(F.col(f"`{person}`").isNotNull() & F.col(f"`{date}`").isNotNull()).select(F.col(f"`{person}`").alias("id"), month).distinct()
    dated = seen.withColumn("first", F.min("m").over(W.partitionBy("id")))
    later = F.col("m") - F.col("first")
    met = dated.groupBy("first", later.alias("later")).agg(F.count("*").alias("back"))
    sizes = met.where("later = 0").select(F.col("first").alias("f"), F.col("back").alias("size"))
    last = seen.agg(F.max("m").alias("last"))
    every = sizes.crossJoin(F.broadcast(last)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(min(months, 12)))))
    joined = every.join(met, (F.col("f") == F.col("first")) & (F.col("k") == F.col("later")), "left")
    known = F.col("f") + F.col("k") <= F.col("last")
    name = F.format_string("%04d-%02d", F.floor(F.col("f") / 12).cast("int"), (F.col("f") % 12 + 1).cast("int"))
    back = F.when(known, F.coalesce("back", F.lit(0)))
    return joined.select(name.alias("cohort"), "size", F.col("k").alias("later"), back.alias("back"), (back / F.col("size")).alias("rate"))


def reached(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.coalesce(c if kind_of(df, name) == "boolean" else c > 0, F.lit(False))


def nested_steps(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Yes/no columns, most to fewest yes, each at least 95 % within the one before; counts of all pairs in one job."""
    names = [c for c in (columns or df.columns) if kind_of(df, c) == "boolean"]
    both = {(a, b): F.count_if(reached(df, a) & reached(df, b)) for a in names for b in names if a <= b}
    if not both:
        return []
    found = dict(zip(both, df.agg(*[x.alias(f"c{i}") for i, x in enumerate(both.values())]).first(), strict=True))
    count = lambda a, b: found[min(a, b), max(a, b)]
    chain: list[str] = []
    for c in sorted((c for c in names if count(c, c)), key=lambda c: -count(c, c)):
        if not chain or count(c, chain[-1]) >= 0.95 * count(c, c) and count(c, c) < count(chain[-1], chain[-1]):
            chain.append(c)
    return chain[:6] if len(chain) >= 2 else []


def funnel(df: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(step, name, n, of_start, of_previous): rows that reached each step and all before it, in one pass."""
    so_far, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, s in enumerate(steps):
        so_far = so_far & reached(df, s)
        counts.append(F.count_if(so_far).alias(f"n{i + 1}"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"n{max(i - 1, 0)}").alias("b")) for i, n in enumerate(["All rows", *steps])]
    table = df.agg(*counts).select("n0", F.inline(F.array(*rows)))
    share = lambda of: F.coalesce(F.try_divide(F.col("n"), F.col(of)), F.lit(0.0))
    return table.select("step", "name", "n", share("n0").alias("of_start"), F.when(F.col("step") == 0, 1.0).otherwise(share("b")).alias("of_previous"))


def pattern(df: DataFrame, date: str, measure: str | None, unit: str) -> DataFrame:
    """(slot, n, effect): the mean of the days of each weekday (0 Monday) or month (1 to 12) against that of all days."""
    days = totals(df, date, measure, "day")
    slot = F.weekday("at") if unit == "weekday" else F.month("at")
    whole = days.agg(F.avg("y").alias("all"))
    made = days.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    return made.crossJoin(F.broadcast(whole)).select("slot", "n", (F.try_divide("mean", "all") - 1).alias("effect"))


def trend(df: DataFrame, date: str, measure: str | None) -> DataFrame:
    """One row: step (month for 120 days or more, else week), steps, slope a step of the mean of a day, that slope as a
    share of the mean, and span in days. Means of days, so a step that is half over is no fall."""
    days = totals(df, date, measure, "day")
    ends = days.agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n")).first()
    if ends.n < 14:
        raise ValueError(f"This needs at least two weeks of dates; the data has {ends.n} different days.")
    span = (ends.b - ends.a).days
    step = "month" if span >= 120 else "week"
    key = start_of(F.col("at"), "month") if step == "month" else F.floor(F.datediff("at", F.lit(ends.a)) / 7)
    buckets = days.groupBy(key.alias("k")).agg(F.avg("y").alias("y"))
    placed = buckets.withColumn("x", F.row_number().over(W.orderBy("k")) - 1)
    slope = F.coalesce(F.regr_slope("y", "x"), F.lit(0.0))
    return placed.agg(F.count("*").alias("steps"), slope.alias("slope"), F.coalesce(F.try_divide(slope, F.avg("y")), F.lit(0.0)).alias("share")).select(
        F.lit(step).alias("step"), "steps", "slope", "share", F.lit(span).alias("span")
    )


def yearly_matters(span: int) -> bool:
    """Two years of days, about."""
    return span >= 2 * DAYS_A_YEAR - 30


def delayed(df: DataFrame, date: str, cause: str, effect: str, unit: str = "day") -> DataFrame:
    """(lag, n, r): how the effect's mean of a day or month goes with the cause's so many days (0-7) or months (0-3)
    before; null with fewer than eight pairs."""
    key = F.datediff(F.col(f"`{date}`"), F.lit("1970-01-01")) if unit == "day" else F.year(F.col(f"`{date}`")) * 12 + F.month(F.col(f"`{date}`"))
    means = df.where(F.col(f"`{date}`").isNotNull()).groupBy(key.alias("k")).agg(F.avg(num(cause)).alias("c"), F.avg(num(effect)).alias("e"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(7 if unit == "day" else 3)))
    earlier = means.select((F.col("k")).alias("_k"), F.col("c").alias("_c"))
    pairs = means.select("k", "e", lags.alias("lag")).join(earlier, F.col("k") - F.col("lag") == F.col("_k"), "left")
    n = F.count_if(F.col("_c").isNotNull() & F.col("e").isNotNull())
    return pairs.groupBy("lag").agg(n.alias("n"), F.when(n >= 8, pearson(F.col("_c"), F.col("e"))).alias("r"))


@dataclass(frozen=True)
class WhatIf:
    """A linear model: number columns, yes/no columns and label columns with a coefficient for each level but the first."""

    target: str
    numbers: list[str]
    flags: list[str]
    levels: dict[str, list[str]]
    typical: dict[str, object]
    coefficients: np.ndarray = field(repr=False)
    r2: float
    deviation: float
    n: int

    def encoded(self, df: DataFrame | None, values: dict[str, object] | None = None) -> list:
        """The model's terms of a row of ``df``, or of given values; missing ones are typical."""
        at = lambda c: F.col(f"`{c}`") if values is None else values.get(c)
        if values is None:
            out = [F.lit(1.0), *[F.coalesce(num(c), F.lit(self.typical[c])) for c in self.numbers]]
            out += [F.coalesce(at(c), F.lit(self.typical[c])).cast("int").cast("double") for c in self.flags]
            return out + [(F.coalesce(at(c).cast("string"), F.lit(ls[0])) == x).cast("int").cast("double") for c, ls in self.levels.items() for x in ls[1:]]
        own = {c: self.typical[c] if values.get(c) is None else values[c] for c in self.typical}
        return [1.0, *[float(own[c]) for c in self.numbers], *[float(bool(own[c])) for c in self.flags], *[float(str(own[c]) == x) for c, ls in self.levels.items() for x in ls[1:]]]

    def predict(self, values: dict[str, object]) -> tuple[float, float, float]:
        """Value and the ends of its 80 % interval."""
        y = float(np.dot(self.encoded(None, values), self.coefficients))
        return y, y - Z80 * self.deviation, y + Z80 * self.deviation

    def column(self, df: DataFrame) -> Column:
        """The prediction for each row."""
        out = F.lit(0.0)
        for x, k in zip(self.encoded(df), self.coefficients.tolist(), strict=True):
            out = out + x * F.lit(k)
        return out


def what_if(df: DataFrame, target: str, inputs: Sequence[str] | None = None, most: int = 5) -> WhatIf:
    """Least squares of the target on other columns: one job for their strengths, one for the products of all terms.

    Without ``inputs`` the ``most`` strongest are taken: numbers by their correlation, yes/no and label columns of up to
    eight levels count 0.15. The matrix has a row a term, so its size does not grow with the table.
    """
    held = df.where(F.col(f"`{target}`").isNotNull())
    others = [c for c in (inputs or df.columns) if c != target]
    kinds = {c: kind_of(df, c) for c in others}
    numbers = [c for c in others if kinds[c] == "number"]
    few = distinct_counts(held, [c for c in others if kinds[c] in ("category", "boolean")])
    strength = {c: 0.15 for c, n in few.items() if 2 <= n <= 8}
    if numbers:
        found = held.agg(*[pearson(num(c), num(target)).alias(f"r{i}") for i, c in enumerate(numbers)]).first()
        strength |= {c: abs(r) for c, r in zip(numbers, found, strict=True) if r is not None}
    chosen = [c for c in inputs if c in strength] if inputs else sorted(strength, key=lambda c: -strength[c])[:most]
    if not chosen:
        raise ValueError(f"There are no other columns to predict {target} from.")
    numbers, flags, names = ([c for c in chosen if kinds[c] == k] for k in ("number", "boolean", "category"))
    typical: dict[str, object] = {}
    if numbers:
        typical |= {c: None for c in numbers} | {c: q for c, (q,) in of_columns(held, {c: num(c) for c in numbers}, (0.5,)).items()}
    if flags:
        typical |= {c: v >= 0.5 for c, v in zip(flags, held.agg(*[F.avg(F.coalesce(F.col(f"`{c}`"), F.lit(False)).cast("int")) for c in flags]).first(), strict=True)}
    levels = {c: [str(r[0]) for r in held.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`")).count().orderBy(F.desc("count"), F.col(f"`{c}`")).limit(8).collect()] for c in names}
    typical |= {c: ls[0] for c, ls in levels.items()}
    shape = WhatIf(target, numbers, flags, levels, typical, np.zeros(0), 0.0, 0.0, 0)
    terms = [x.alias(f"x{i}") for i, x in enumerate(shape.encoded(held))]
    rows, p, y = held.select(*terms, num(target).alias("y")), len(terms), F.col("y")
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
    sums = rows.agg(*products, *[F.sum(F.col(f"x{i}") * y) for i in range(p)], F.count("*"), F.avg("y"), F.var_pop("y")).first()
    if sums[-3] < 15:
        raise ValueError(f"Predicting {target} needs at least 15 rows where it is filled in.")
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = sums[: p * (p + 1) // 2]
    a = a + a.T - np.diag(np.diag(a))
    n = sums[-3]
    ridge = np.diag([0.0, *[1e-6 * n] * (p - 1)])
    k = np.linalg.lstsq(a + ridge, np.array(sums[p * (p + 1) // 2 : p * (p + 1) // 2 + p], dtype=float), rcond=None)[0]
    model = WhatIf(target, numbers, flags, levels, typical, k, 0.0, 0.0, n)
    rest = held.agg(F.sum((num(target) - model.column(held)) ** 2)).first()[0]
    whole = sums[-1] * n
    return WhatIf(target, numbers, flags, levels, typical, k, max(0.0, 1 - rest / whole) if whole else 0.0, math.sqrt(rest / max(1, n - p)), n)


def natural_groups(df: DataFrame, columns: Sequence[str], k: int | None = None, order: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """``df`` with ``segment`` (1 the largest group; null where most values are missing) and the number of groups. The sample
    that they are fitted to is spread over the rows in their ``order``."""
    model = groups.fitted(df, columns, k, order)
    return model.labelled(df), len(model.centres)
