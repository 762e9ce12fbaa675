"""Significance tests from sufficient statistics that one aggregation gives."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import tails
from ..functions.special import chi_tail, f_tail, t_limit, t_tail
from ..functions.values import kind_of
from .stats import num, pearson
from .summarize import number

MOST_LEVELS = 30


@dataclass(frozen=True)
class Welch:
    n1: int
    n2: int
    mean1: float
    mean2: float
    diff: float
    t: float
    df: float
    p: float
    ci: tuple[float, float]
    d: float


@dataclass(frozen=True)
class Anova:
    f: float
    df1: int
    df2: int
    p: float
    eta2: float


@dataclass(frozen=True)
class ChiSquare:
    chi2: float
    df: int
    p: float
    n: int
    v: float
    low_share: float


@dataclass(frozen=True)
class Correlation:
    r: float
    n: int
    t: float
    p: float


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, n, mean, var), the sample variance, of each group, without missing groups and values."""
    held = df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{value}`").isNotNull())
    x = number(df, value)
    return held.groupBy(F.col(f"`{group}`").alias("g")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"))


def group_moments(df: DataFrame, group: str, value: str) -> dict[object, tuple[int, float, float]]:
    """group -> (n, mean, sample variance). One row per group comes back, so it is for few groups."""
    return {r[0]: (r[1], r[2], r[3]) for r in moments(df, group, value).collect()}


def welch_from(a: tuple[int, float, float], b: tuple[int, float, float]) -> Welch | None:
    (n1, m1, v1), (n2, m2, v2) = a, b
    if n1 < 2 or n2 < 2:
        return None
    s1, s2, diff = v1 / n1, v2 / n2, m1 - m2
    if s1 + s2 == 0:
        same = diff == 0
        return Welch(n1, n2, m1, m2, diff, 0.0 if same else math.inf, n1 + n2 - 2, float(same), (diff, diff), 0.0 if same else math.inf)
    error = math.sqrt(s1 + s2)
    df = (s1 + s2) ** 2 / (s1**2 / (n1 - 1) + s2**2 / (n2 - 1))
    margin, spread = t_limit(df) * error, math.sqrt((v1 + v2) / 2)
    return Welch(n1, n2, m1, m2, diff, diff / error, df, t_tail(diff / error, df), (diff - margin, diff + margin), diff / spread if spread else 0.0)


def welch(df: DataFrame, group: str, value: str, first: object, second: object) -> Welch | None:
    """Do two groups differ in their mean?"""
    found = group_moments(df.where(F.col(f"`{group}`").isin(first, second)), group, value)
    return welch_from(found[first], found[second]) if first in found and second in found else None


def anova_of(n: int, k: int, between: float, within: float) -> Anova | None:
    if k < 2 or n <= k:
        return None
    if within == 0:
        return Anova(math.inf if between else 0.0, k - 1, n - k, 0.0 if between else 1.0, 1.0 if between else 0.0)
    f = between / (k - 1) / (within / (n - k))
    return Anova(f, k - 1, n - k, f_tail(f, k - 1, n - k), between / (between + within))


def anova_from(groups: list[tuple[int, float, float]]) -> Anova | None:
    held = [g for g in groups if g[0] >= 2]
    n, k = sum(g[0] for g in held), len(held)
    if not n:
        return None
    grand = sum(c * m for c, m, _ in held) / n
    return anova_of(n, k, sum(c * (m - grand) ** 2 for c, m, _ in held), sum((c - 1) * v for c, _, v in held))


def anova(df: DataFrame, group: str, value: str) -> Anova | None:
    """Do groups differ in their means? Any number of groups; only their sums come back."""
    held = moments(df, group, value).where("n >= 2")
    n, k, total, within = held.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col("mean")), F.sum((F.col("n") - 1) * F.col("var"))).first()
    if not n or total is None:
        return None
    between = held.agg(F.sum(F.col("n") * F.pow(F.col("mean") - total / n, F.lit(2)))).first()[0]
    return anova_of(n, k, between, within)


def contingency(df: DataFrame, a: str, b: str, most: int) -> list[tuple[object, object, int]]:
    held = df.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
    made = held.groupBy(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).agg(F.count("*").alias("n"))
    return [tuple(r) for r in made.limit(most).collect()]


def chi_square_from(cells: list[tuple[object, object, int]]) -> ChiSquare | None:
    rows: dict[object, int] = {}
    columns: dict[object, int] = {}
    for a, b, n in cells:
        rows[a] = rows.get(a, 0) + n
        columns[b] = columns.get(b, 0) + n
    r, c, total = len(rows), len(columns), sum(rows.values())
    if not (2 <= r <= MOST_LEVELS and 2 <= c <= MOST_LEVELS):
        return None
    seen = {(a, b): n for a, b, n in cells}
    expected = {(a, b): x * y / total for a, x in rows.items() for b, y in columns.items()}
    chi2 = sum((seen.get(k, 0) - e) ** 2 / e for k, e in expected.items())
    df = (r - 1) * (c - 1)
    low = sum(e < 5 for e in expected.values()) / (r * c)
    return ChiSquare(chi2, df, chi_tail(chi2, df), total, math.sqrt(chi2 / (total * (min(r, c) - 1))), low)


def chi_square(df: DataFrame, a: str, b: str) -> ChiSquare | None:
    """Are two label columns related? Up to 30 levels each."""
    return chi_square_from(contingency(df, a, b, MOST_LEVELS * MOST_LEVELS + 1))


def correlation(df: DataFrame, x: str, y: str) -> Correlation | None:
    return correlation_of(*df.agg(pearson(num(x), num(y)), F.count_if(num(x).isNotNull() & num(y).isNotNull())).first())


def correlation_of(r: float | None, n: int) -> Correlation | None:
    if r is None or n < 4:
        return None
    if abs(r) >= 1:
        return Correlation(r, n, math.inf, 0.0)
    t = r * math.sqrt((n - 2) / (1 - r * r))
    return Correlation(r, n, t, t_tail(t, n - 2))


def test_columns(df: DataFrame, a: str, b: str) -> Welch | Anova | ChiSquare | Correlation | None:
    """The test that fits the kinds of two columns."""
    numeric = [kind_of(df, c) == "number" for c in (a, b)]
    if all(numeric):
        return correlation(df, a, b)
    if any(numeric):
        group, value = (b, a) if numeric[0] else (a, b)
        # one group more than are tested tells that there are too many, whichever it is
        usable = moments(df, group, value).where("n >= 2").limit(MOST_LEVELS + 1)
        found = [(r[1], r[2], r[3]) for r in usable.collect()]
        if len(found) == 2:
            return welch_from(*found)
        return anova_from(found) if 3 <= len(found) <= MOST_LEVELS else None
    return chi_square(df, a, b)


def welch_by(df: DataFrame, by: str, group: str, value: str, first: object, second: object) -> DataFrame:
    """(by, n1, n2, mean1, mean2, t, df, p): two groups' means compared within each value of ``by``, all in one job. Values of
    ``by`` with fewer than two rows of a group have no row."""
    g, x = F.col(f"`{group}`"), number(df, value)
    held = df.where(g.isin(first, second) & x.isNotNull() & F.col(f"`{by}`").isNotNull())
    own = {k: F.when(g == F.lit(v), x) for k, v in ((1, first), (2, second))}
    parts = [f(own[k]).alias(f"{n}{k}") for k in own for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    made = held.groupBy(F.col(f"`{by}`").alias("by")).agg(*parts).where("n1 > 1 AND n2 > 1")
    made = made.withColumns({"s1": F.col("var1") / F.col("n1"), "s2": F.col("var2") / F.col("n2")})
    error, diff = F.col("s1") + F.col("s2"), F.col("mean1") - F.col("mean2")
    freedom = error * error / (F.col("s1") * F.col("s1") / (F.col("n1") - 1) + F.col("s2") * F.col("s2") / (F.col("n2") - 1))
    made = made.withColumns({
        "t": F.when(error > 0, diff / F.sqrt(error)).otherwise(F.when(diff == 0, 0.0).otherwise(float("inf"))),
        "df": F.when(error > 0, freedom).otherwise((F.col("n1") + F.col("n2") - 2).cast("double")),
    })
    return made.select("by", "n1", "n2", "mean1", "mean2", "t", "df", tails.t_tail(F.col("t"), F.col("df")).alias("p"))


def correlation_by(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, r, t, p): the correlation of two columns within each value of ``by``; none for fewer than four complete rows."""
    both = num(x).isNotNull() & num(y).isNotNull()
    made = df.where(F.col(f"`{by}`").isNotNull()).groupBy(F.col(f"`{by}`").alias("by")).agg(F.count_if(both).alias("n"), pearson(num(x), num(y)).alias("r"))
    r, n = F.col("r"), F.col("n")
    t = F.when(F.abs(r) >= 1, float("inf")).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))
    return made.where("n > 3 AND r IS NOT NULL").withColumn("t", t).select("by", "n", "r", "t", tails.t_tail(F.col("t"), n - 2).alias("p"))


def anova_by(df: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """(by, f, df1, df2, p, eta2): whether groups differ in their means, within each value of ``by``; groups of one row do not count."""
    g, x = F.col(f"`{group}`"), number(df, value)
    held = df.where(g.isNotNull() & x.isNotNull() & F.col(f"`{by}`").isNotNull())
    each = held.groupBy(F.col(f"`{by}`").alias("by"), g.alias("g")).agg(F.count("*").alias("c"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).where("c > 1")
    c, m = F.col("c"), F.col("m")
    sums = each.groupBy("by").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(c * m).alias("s"), F.sum(c * m * m).alias("q"), F.sum((c - 1) * F.col("v")).alias("within"))
    made = sums.where("k > 1 AND n > k").withColumn("between", F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.when(F.col("within") > 0, F.col("between") / df1 / (F.col("within") / df2)).otherwise(F.when(F.col("between") > 0, float("inf")).otherwise(0.0))
    eta2 = F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("within")), F.lit(0.0))
    made = made.select("by", f.alias("f"), df1.alias("df1"), df2.alias("df2"), eta2.alias("eta2"))
    return made.select("by", "f", "df1", "df2", tails.f_tail(F.col("f"), F.col("df1"), F.col("df2")).alias("p"), "eta2")


def p_words(p: float) -> str:
    """A probability as it is written."""
    return "p < 0.001" if p < 0.001 else f"p = {p:.3f}" if p < 0.1 else f"p = {p:.2f}"


def verdict(p: float | None) -> str:
    """How sure a difference is."""
    if p is None:
        return "not enough data to tell"
    return next(w for most, w in ((0.001, "almost certainly real"), (0.05, "likely real"), (0.2, "could be luck"), (2, "probably just luck")) if p < most)


def effect_size(d: float) -> str:
    """How large a difference is, in standard deviations."""
    return next(w for least, w in ((0.8, "a big difference"), (0.5, "a clear difference"), (0.2, "a small difference"), (-1, "about the same")) if abs(d) >= least)
