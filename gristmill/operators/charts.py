"""Data of charts as short frames: lines, bars, stacks, boxes, calendars, points."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.values import kind_of, number_text
from .quantiles import QUARTERS, quantiles
from .series import chart_unit, start_of, totals
from .sorting import even_sample
from .stats import num
from .summarize import MISSING, OTHER, Agg, first_frequencies, group_key, ordered, summarised

#: Points of a chart that its table shows.
MOST_SHOWN = 500
MOST_BARS, MOST_BOXES, MOST_COLOURS, MOST_POINTS, MOST_DAYS = 30, 15, 6, 5000, 371


def coloured(df: DataFrame, by: str, most: int = MOST_COLOURS) -> DataFrame:
    """``df`` with ``colour``: the most frequent labels of a column, all others (and missing) as one."""
    key = group_key(df, by).cast("string")
    real = df.select(key.alias("k")).where(F.col("k") != MISSING)
    top = [r["value"] for r in first_frequencies(real, "k", most).collect()]
    return df.withColumn("colour", F.when(key.isin(*top), key).otherwise(OTHER))


def line(df: DataFrame, x: str, y: str | None = None, agg: str = "mean", colour: str | None = None, unit: str | None = None) -> DataFrame:
    """(x, y) or (colour, x, y): one value a date bucket or number; buckets without numbers have no point."""
    at = F.col(f"`{x}`")
    if kind_of(df, x) == "date":
        at = start_of(at, unit or chart_unit(df, x))
    held = (coloured(df, colour) if colour else df).where(F.col(f"`{x}`").isNotNull())
    keys = [*(["colour"] if colour else []), "_at"]
    made = summarised(held.withColumn("_at", at), keys, [Agg(agg, y) if y else Agg()], ["_y"], df)
    return made.select(*keys[:-1], F.col("_at").alias("x"), F.col("_y").cast("double").alias("y")).where("y IS NOT NULL")


def bars(df: DataFrame, x: str, y: str | None = None, agg: str = "mean") -> DataFrame:
    """(label, value, rank): the largest bars, in the labels' own order if they have one."""
    keyed = df.withColumn("label", group_key(df, x)).where(F.col("label").isNotNull() & (F.col("label").cast("string") != MISSING))
    made = summarised(keyed, ["label"], [Agg(agg, y) if y else Agg()], ["_y"], df).select("label", F.col("_y").cast("double").alias("value")).where("value IS NOT NULL")
    kind = kind_of(df, x)
    # the natural order only holds for few labels; of many, the largest are shown
    if kind in ("number", "date"):
        shown = made.orderBy("label").limit(MOST_BARS)
    else:
        shown = made.orderBy(F.desc("value"), "label").limit(MOST_BARS)
    return ordered(shown, "label", "value", kind, "month" if kind == "date" else None)


def stacked(df: DataFrame, x: str, colour: str, y: str | None = None) -> DataFrame:
    """(label, colour, value): totals or rows by two columns; missing labels are left out, missing values add nothing."""
    value = F.sum(F.coalesce(num(y), F.lit(0.0))) if y else F.count(F.lit(1)).cast("double")
    keyed = coloured(df, colour).withColumn("label", group_key(df, x).cast("string")).where(F.col("label") != MISSING)
    return keyed.groupBy("label", "colour").agg(value.alias("value"))


def boxes(df: DataFrame, by: str, y: str) -> DataFrame:
    """(label, n, whisker_low, q1, median, q3, whisker_high, mean, outliers) of the 15 largest groups.

    Whiskers end at the last value within 1.5 interquartile ranges of the box.
    """
    keyed = df.withColumn("label", group_key(df, by).cast("string")).where(num(y).isNotNull()).select(F.coalesce("label", F.lit(MISSING)).alias("label"), num(y).alias("y"))
    largest = keyed.groupBy("label").agg(F.count("*").alias("n"), F.avg("y").alias("mean")).orderBy(F.desc("n"), "label").limit(MOST_BOXES)
    held = keyed.join(F.broadcast(largest.select("label")), "label")
    first = largest.join(quantiles(held, ["label"], F.col("y"), QUARTERS), "label")
    iqr = F.col("q")[2] - F.col("q")[0]
    fenced = held.join(F.broadcast(first.withColumns({"a": F.col("q")[0] - 1.5 * iqr, "b": F.col("q")[2] + 1.5 * iqr})), "label")
    inside = F.when(F.col("y").between(F.col("a"), F.col("b")), F.col("y"))
    made = fenced.groupBy("label", "n", "q", "mean").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), F.count_if(~F.col("y").between(F.col("a"), F.col("b"))).alias("outliers"))
    return made.select("label", "n", "whisker_low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_high", "mean", "outliers")


def calendar(df: DataFrame, date: str, y: str | None = None) -> DataFrame:
    """(day, value) of the last 371 days, also those without rows."""
    days = totals(df, date, y, "day")
    ends = days.agg(F.to_date(F.min("at")).alias("a"), F.to_date(F.max("at")).alias("b")).where("b IS NOT NULL")
    start = F.greatest("a", F.date_sub("b", MOST_DAYS - 1))
    every = ends.select(F.explode(F.sequence(start, F.col("b"), F.expr("INTERVAL 1 day"))).alias("day"))
    return every.join(days.select(F.to_date("at").alias("day"), F.col("y").alias("value")), "day", "left")


def points(df: DataFrame, x: str, y: str, colour: str | None = None, row: str = "_rid") -> DataFrame:
    """(x, y) or (x, y, colour): rows with both numbers, 5,000 at even distances if there are more.

    ``row`` numbers the rows with both from 0 (``with_row_numbers``).
    """
    held = coloured(df, colour, 7) if colour else df
    shown = even_sample(held, MOST_POINTS, row)
    return shown.select(num(x).alias("x"), num(y).alias("y"), *(["colour"] if colour else []))


def notes_on(df: DataFrame, x: str, notes: Sequence[dict[str, str]]) -> list[tuple[dt.datetime, str]]:
    """(day, text) of the notes ({date: 'YYYY-MM-DD', text}) that can stand on the axis ``x``: none if it has no dates;
    notes without a readable date or a text are left out."""
    if kind_of(df, x) != "date":
        return []
    out = []
    for n in notes:
        try:
            at = dt.datetime.strptime(n.get("date") or "", "%Y-%m-%d")
        except ValueError:
            continue
        if n.get("text"):
            out.append((at, n["text"]))
    return out


def as_table(made: DataFrame, kind: str) -> DataFrame:
    """The numbers behind a chart that this module or ``stats.histogram`` made, as a short table in reading order.

    Bars, boxes and bins in their order; a column a colour and their total for stacked bars, a column a colour for lines
    (at most six and Other); days with a value; the first 500 points.
    """
    text = lambda c: number_text(F.col(c))
    if kind == "bar":
        return made.orderBy("rank").select("label", text("value").alias("value"))
    if kind == "stacked":
        wide = made.groupBy("label").pivot("colour").agg(F.sum("value"))
        parts = wide.columns[1:]
        total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in parts), F.lit(0.0))
        return wide.orderBy("label").select("label", *[F.coalesce(text(f"`{c}`"), F.lit("")).alias(c) for c in parts], number_text(total).alias("Total"))
    if kind == "histogram":
        return made.orderBy("bin").select(text("low").alias("from"), text("high").alias("to"), F.col("n").alias("Rows"))
    if kind == "box":
        return made.orderBy(F.desc("n"), "label").select("label", F.col("n").alias("Rows"), *[text(c).alias(c) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")])
    if kind == "calendar":
        return made.where("value IS NOT NULL").orderBy("day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), text("value").alias("value"))
    if kind == "scatter":
        return made.limit(MOST_SHOWN).select(text("x").alias("x"), text("y").alias("y"), *(["colour"] if "colour" in made.columns else []))
    if kind == "line":
        x = F.date_format("x", "yyyy-MM-dd") if kind_of(made, "x") == "date" else text("x")
        if "colour" not in made.columns:
            return made.orderBy("x").select(x.alias("x"), text("y").alias("y"))
        wide = made.groupBy("x").pivot("colour").agg(F.sum("y"))
        return wide.orderBy("x").select(x.alias("x"), *[F.coalesce(text(f"`{c}`"), F.lit("")).alias(c) for c in wide.columns[1:]])
    raise ValueError(f"There is no table for a chart of kind {kind}.")
