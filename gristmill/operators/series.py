"""Series over time: buckets, totals, averages of neighbours, gaps, unusual points.

A series has a row per bucket (day, month or year) of a table, so its length is bounded by the calendar, not by the
rows; windows run over whole series, each series of a table with ``keys`` in a partition of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .sorting import running_totals
from .summarize import number

DAYS_A_YEAR = 365
#: Score from which a point is unusual; a normal deviation in units of the median one.
UNUSUAL, NORMAL = 3.5, 1.4826
STEP = {"day": "1 day", "month": "1 month", "year": "1 year"}


def span_in_days(df: DataFrame, date: str) -> float | None:
    """Days between the first and the last date."""
    c = F.unix_micros(F.col(f"`{date}`").cast("timestamp"))
    return df.agg((F.max(c) - F.min(c)) / 86_400_000_000).first()[0]


def period_unit(df: DataFrame, date: str) -> str:
    """Unit for comparing periods: years from three years on, months from 90 days on, else days."""
    days = span_in_days(df, date)
    return "month" if days is None else "year" if days >= 3 * DAYS_A_YEAR else "month" if days >= 90 else "day"


def chart_unit(df: DataFrame, date: str) -> str:
    """Unit for a line: days up to 400, months up to ten years, else years."""
    days = span_in_days(df, date) or 0
    return "day" if days <= 400 else "month" if days <= 3650 else "year"


def start_of(c: Column, unit: str) -> Column:
    return F.date_trunc(unit, c.cast("timestamp")).cast("timestamp_ntz")


def totals(df: DataFrame, date: str, measure: str | None, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, at, y): sum of the measure, missing ones as 0, or number of rows, for each bucket with rows."""
    y = F.sum(F.coalesce(number(df, measure), F.lit(0.0))) if measure else F.count(F.lit(1)).cast("double")
    dated = df.where(F.col(f"`{date}`").isNotNull())
    return dated.groupBy(*keys, start_of(F.col(f"`{date}`"), unit).alias("at")).agg(y.alias("y"))


def moving_average(series: DataFrame, width: int, at: str = "at", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """``series`` with ``smooth``: the mean of width // 2 points on either side and the point, fewer at the ends."""
    half = width // 2
    return series.withColumn("smooth", F.avg(y).over(W.partitionBy(*keys).orderBy(at).rowsBetween(-half, half)))


def smoothing_width(points: int, unit: str | None) -> int:
    """0 up to 60 points; then a week of days, else a twentieth of the points, odd, 3 at least."""
    return 0 if points <= 60 else 7 if unit == "day" else max(3, int(points / 20 + 0.5) | 1)


def running_share(df: DataFrame, by: str, measure: str | None) -> DataFrame:
    """(label, value, share, cumulative) of labels with a positive total, biggest first.

    Totals are summed along ranges of values, so labels may be as many as rows.
    """
    held = df.where(F.col(f"`{by}`").isNotNull())
    value = F.sum(F.coalesce(number(df, measure), F.lit(0.0))) if measure else F.count(F.lit(1)).cast("double")
    items = held.groupBy(F.col(f"`{by}`").alias("label")).agg(value.alias("value")).where("value > 0")
    summed = running_totals(items, [F.col("value").desc(), F.col("label")], "value")
    share = F.col("value") / F.col("total")
    return summed.select("label", "value", share.alias("share"), (F.col("running") / F.col("total")).alias("cumulative"))


def expected(series: DataFrame, weekly: bool, keys: Sequence[str] = ()) -> DataFrame:
    """``series`` with ``expected``: the median of comparable other points, or the point itself if there are none.

    ``weekly``: the same weekday up to five weeks away; else up to three points away on either side.
    """
    if weekly:
        gap = lambda a, b: F.abs(F.datediff(a, b))
        weekday = F.weekday("at")
        own, other = series.withColumn("_w", weekday), series.select(*keys, F.col("at").alias("_at"), F.col("y").alias("_y"), weekday.alias("_w"))
        near = own.join(other, [*keys, "_w"]).where((gap(F.col("at"), F.col("_at")) <= 35) & (F.col("at") != F.col("_at")))
    else:
        row = F.row_number().over(W.partitionBy(*keys).orderBy("at"))
        own, other = series.withColumn("_n", row), series.select(*keys, F.col("y").alias("_y"), row.alias("_m"))
        pairs = own.withColumn("_m", F.explode(F.sequence(F.col("_n") - 3, F.col("_n") + 3))).where("_m != _n")
        near = pairs.join(other, [*keys, "_m"])
    middle = near.groupBy(*keys, "at").agg(F.median("_y").alias("_middle"))
    joined = series.join(middle, [*keys, "at"], "left")
    return joined.withColumn("expected", F.coalesce("_middle", "y")).drop("_middle")


def scored(series: DataFrame, weekly: bool) -> DataFrame:
    """``series`` with expected and score: the distance from it in robust deviations of all distances."""
    apart = expected(series, weekly).withColumn("_r", F.col("y") - F.col("expected"))
    middle = apart.agg(F.median("_r").alias("_m"))
    away = apart.crossJoin(F.broadcast(middle)).withColumn("_d", F.abs(F.col("_r") - F.col("_m")))
    spread = away.agg(F.median("_d").alias("_half"), F.avg("_d").alias("_mean"))
    unit = F.when(F.col("_half") > 0, NORMAL * F.col("_half")).when(F.col("_mean") > 0, 1.25 * F.col("_mean")).otherwise(1.0)
    return apart.crossJoin(F.broadcast(spread)).withColumn("score", F.col("_r") / unit).select("at", "y", "expected", "score")


def unusual(df: DataFrame, date: str, measure: str | None, unit: str | None = None) -> DataFrame:
    """(at, y, expected, score) of the days, or months if there are few or very many days, that stand out."""
    if unit is None:
        days = df.select(F.to_date(F.col(f"`{date}`")).alias("d")).where("d IS NOT NULL").distinct().count()
        unit = "day" if 28 <= days <= 2000 else "month"
    series = totals(df, date, measure, unit)
    points = series.count()
    if points < 10:
        raise ValueError(f"Spotting unusual {unit}s needs at least 10 of them; this data has {points}.")
    return scored(series, unit == "day" and points >= 28).where(F.abs("score") >= UNUSUAL)


def regular(series: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """``series`` with a row for every bucket from its first to its last; ``filled`` ones lie on the straight line
    between their neighbours."""
    ends = series.groupBy(*keys).agg(F.min("at").alias("_a"), F.max("at").alias("_b"))
    every = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {STEP[unit]}"))).alias("at"))
    placed = every.join(series, [*keys, "at"], "left")
    order = W.partitionBy(*keys).orderBy("at")
    known = F.when(F.col("y").isNotNull(), F.struct("y", F.row_number().over(order).alias("n")))
    marked = placed.withColumns({"_n": F.row_number().over(order), "_known": known})
    before = F.last("_known", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("_known", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    near = marked.withColumns({"_before": before, "_after": after})
    line = F.col("_before.y") + (F.col("_after.y") - F.col("_before.y")) * (F.col("_n") - F.col("_before.n")) / (F.col("_after.n") - F.col("_before.n"))
    return near.select(*keys, "at", F.coalesce("y", line).alias("y"), F.col("y").isNull().alias("filled"))
