"""Tail probabilities as expressions, so that tests run for many groups or pairs at once, within Spark.

The continued fractions and series of ``special`` are folds over a fixed number of steps, enough for twelve digits at the
sizes that tests have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .values import let

STEPS = 300
TINY = 1e-300
#: Coefficients of the Lanczos approximation of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of a number above 0."""

    def of(z: Column) -> Column:
        z = z - 1.0
        total = F.lit(LANCZOS[0])
        for i, k in enumerate(LANCZOS[1:], 1):
            total = total + F.lit(k) / (z + float(i))
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)

    return let(x.cast("double"), of)


def _off_zero(c: Column) -> Column:
    return F.when(F.abs(c) < TINY, F.lit(TINY)).otherwise(c)


def _fraction(steps: Column, first: Column, term) -> Column:
    """A continued fraction by Lentz's method; ``term(k)`` is its k-th (numerator, denominator)."""
    start = F.struct(first.alias("v"), first.alias("c"), F.lit(0.0).alias("d"))

    def step(s: Column, k: Column) -> Column:
        def scaled(t: Column) -> Column:
            d = F.lit(1.0) / _off_zero(t["b"] + t["a"] * s["d"])
            c = _off_zero(t["b"] + t["a"] / s["c"])
            return let(F.struct(c.alias("c"), d.alias("d")), lambda x: F.struct((s["v"] * x["c"] * x["d"]).alias("v"), x["c"].alias("c"), x["d"].alias("d")))

        a, b = term(k)
        return let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), scaled)

    return F.aggregate(steps, start, step)["v"]


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function of positive ``a`` and ``b``."""

    def part(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]

        def term(k: Column) -> tuple[Column, Column]:
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd), F.lit(1.0)

        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
        share = front / _fraction(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(1.0), term)
        return F.when(s["turned"], 1.0 - share).otherwise(share)

    def ordered(s: Column) -> Column:
        turned = s["x"] > (s["a"] + 1) / (s["a"] + s["b"] + 2)
        pick = lambda yes, no: F.when(turned, yes).otherwise(no)
        inner = F.struct(pick(s["b"], s["a"]).alias("a"), pick(s["a"], s["b"]).alias("b"), pick(1.0 - s["x"], s["x"]).alias("x"), turned.alias("turned"))
        return F.when(s["x"] <= 0, 0.0).when(s["x"] >= 1, 1.0).otherwise(let(inner, part))

    return let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), ordered)


def gamma_share(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function of positive ``a``."""

    def of(s: Column) -> Column:
        a, x = s["a"], s["x"]
        front = F.exp(a * F.log(x) - x - lgamma(a))

        def longer(t: Column, k: Column) -> Column:
            return let(t["term"] * x / (a + k), lambda term: F.struct(term.alias("term"), (t["total"] + term).alias("total")))

        one = F.lit(1.0) / a
        series = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(one.alias("term"), one.alias("total")), longer)["total"]
        rest = _fraction(F.sequence(F.lit(1), F.lit(STEPS)), x + 1 - a, lambda k: (-k * (k - a), x + 1 - a + 2 * k))
        return F.when(x <= 0, 0.0).when(x < a + 1, front * series).otherwise(1.0 - front / rest)

    return let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), of)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t."""
    return F.when(F.abs(t) == float("inf"), 0.0).otherwise(beta_share(df / 2, F.lit(0.5), df / (df + t * t)))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    return F.when(f == float("inf"), 0.0).when(f <= 0, 1.0).otherwise(beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))


def chi_tail(x: Column, df: Column) -> Column:
    return F.when(x <= 0, 1.0).otherwise(1.0 - gamma_share(df / 2, x / 2))
