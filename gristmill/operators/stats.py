"""Descriptive statistics by aggregations; quantiles by rank."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import of_columns


def num(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: count, sum, mean, std, min, q1, median, q3, max, iqr, skew, fences and number of outliers.

    One pass for the moments of all columns, one for their quartiles and one for the outliers.
    """
    parts = (("n", F.count), ("s", F.sum), ("m", F.avg), ("d", F.stddev_samp), ("lo", F.min), ("hi", F.max), ("sk", F.skewness))
    first = df.agg(*[f(num(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in parts]).first()
    quarts = of_columns(df, {c: num(c) for c in columns})
    rows = []
    for i, c in enumerate(columns):
        n, total, mean, std, low, high, skew = (first[f"{p}{i}"] for p, _ in parts)
        q1, q2, q3 = quarts.get(c, (None, None, None))
        iqr = None if q1 is None else q3 - q1
        skew = None if n < 3 else 0.0 if skew is None or math.isnan(skew) else skew
        fences = (None, None) if iqr is None else (q1 - 1.5 * iqr, q3 + 1.5 * iqr)
        rows.append((c, n, total, mean, std, low, q1, q2, q3, high, iqr, skew, *fences))
    outside = lambda i: F.count_if((num(columns[i]) < F.lit(rows[i][12])) | (num(columns[i]) > F.lit(rows[i][13])))
    counts = df.agg(*[outside(i).alias(f"o{i}") for i in range(len(columns))]).first()
    return df.sparkSession.createDataFrame(
        [(*r, o) for r, o in zip(rows, counts, strict=True)],
        "column_name string, n long, total double, mean double, std double, low double, q1 double, median double, q3 double, high double, "
        "iqr double, skew double, fence_low double, fence_high double, outliers long",
    )


def nice_step(span: float, target: int) -> float:
    """1, 2 or 5 times a power of ten near span/target."""
    rough = span / max(target, 1)
    power = 10.0 ** math.floor(math.log10(rough)) if rough > 0 else 1.0
    ratio = rough / power
    return power * (1 if ratio < 1.5 else 2 if ratio < 3 else 5 if ratio < 7 else 10)


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n) over nice edges, empty bins too; Sturges' number of bins between 5 and 40 by default."""
    low, high, n = df.agg(F.min(num(column)), F.max(num(column)), F.count(num(column))).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        return spark.createDataFrame([(0, low, high, n)], "bin int, low double, high double, n long")
    step = nice_step(high - low, bins or min(40, max(5, math.ceil(math.log2(n) + 1))))
    start = math.floor(low / step) * step
    last = math.ceil(high / step) - math.floor(low / step) - 1
    at = F.least(F.floor((num(column) - start) / step).cast("int"), F.lit(last))
    counted = df.where(num(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.round(F.lit(start) + (F.col("bin") + k) * step, 10)
    return every.join(counted, "bin", "left").select("bin", edge(0).alias("low"), edge(1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def pair_moments(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates of rows that have both."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return {
        "n": F.count_if(both), "sx": F.sum(a), "sy": F.sum(b), "cov": F.covar_pop(a, b), "vx": F.var_pop(a), "vy": F.var_pop(b),
    }


def pearson(x: Column, y: Column) -> Column:
    """Correlation of complete pairs; null with fewer than 3 or without variance."""
    m = pair_moments(x, y)
    spread = F.sqrt(m["vx"]) * F.sqrt(m["vy"])
    return F.when((m["n"] >= 3) & (spread > 0), F.try_divide(m["cov"], spread))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, r) for each pair."""
    from . import gram

    return gram.correlations(df, columns)


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept and r2 of y on x; r2 is 1 for constant y, all are null for constant x."""
    return df.agg(
        F.regr_count(num(y), num(x)).alias("n"),
        F.regr_slope(num(y), num(x)).alias("slope"),
        F.regr_intercept(num(y), num(x)).alias("intercept"),
        F.regr_r2(num(y), num(x)).alias("r2"),
    )


def strength(r: float | None) -> str:
    """Words for the size of a correlation."""
    if r is None or not math.isfinite(r):
        return "unknown"
    return next(w for least, w in ((0.7, "strong"), (0.4, "moderate"), (0.2, "weak"), (-1, "little or no")) if abs(r) >= least)
