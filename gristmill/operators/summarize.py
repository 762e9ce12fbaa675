"""Summaries by group, frequency tables and pivots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import kind_of, natural_key
from .quantiles import quantiles, same_keys

MISSING, OTHER = "(missing)", "Other"
# Sequences of labels with an order of their own.
SEQUENCES = (
    ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"),
    ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
    ("Q1", "Q2", "Q3", "Q4"),
)
UNITS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy", "weekday": "EEE"}
RANGE = r"^(-?\d+(?:\.\d+)?(?:e[-+]?\d+)?) ?– ?-?\d"
LABELS = {
    "distinct": "Number of distinct values", "sum": "Sum", "mean": "Average (mean)", "median": "Median",
    "min": "Minimum", "max": "Maximum", "std": "Standard deviation",
}


@dataclass(frozen=True)
class Agg:
    fn: str = "count"
    column: str | None = None

    def label(self) -> str:
        return "Rows" if self.fn == "count" else f"{LABELS[self.fn]} of {self.column}"


def number(df: DataFrame, name: str) -> Column:
    """A column as double; booleans are 0 and 1."""
    c = F.col(f"`{name}`")
    return c.cast("int").cast("double") if kind_of(df, name) == "boolean" else c.cast("double")


def aggregate(df: DataFrame, a: Agg) -> Column:
    """Nulls do not count; a group without numbers has null, and so has the deviation of one number.

    ``summarised`` takes medians by rank instead; as an aggregate one is for groups of bounded size.
    """
    if a.fn == "count":
        return F.count(F.lit(1))
    if a.fn == "distinct":
        return F.count_distinct(F.col(f"`{a.column}`"))
    made = {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp}
    return made[a.fn](number(df, a.column))


def summarised(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], names: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """``keys`` (columns of ``df``) and the summaries by name. Medians come from ranks, so no task holds a group.

    ``source`` tells the kinds of columns if ``df`` is made of it.
    """
    kinds, named = source if source is not None else df, [F.col(f"`{k}`") for k in keys]
    plain = [(a, n) for a, n in zip(aggs, names, strict=True) if a.fn != "median"]
    whole = df.groupBy(*named)
    out = whole.agg(*[aggregate(kinds, a).alias(n) for a, n in plain]) if plain else df.select(*named).distinct() if keys else df.sparkSession.range(1).select()
    for a, n in zip(aggs, names, strict=True):
        if a.fn == "median":
            middle = quantiles(df, keys, number(kinds, a.column)).select(*[c.alias(f"{k}_of") for c, k in zip(named, keys, strict=True)], F.col("q")[0].alias(n))
            out = out.join(middle, same_keys(keys, "_of"), "left").drop(*[f"{k}_of" for k in keys])
    return out.select(*named, *[F.col(f"`{n}`") for n in names])


def group_key(df: DataFrame, name: str, unit: str = "month") -> Column:
    """Label of a value's group; numbers stay numbers and have null for missing."""
    c, kind = F.col(f"`{name}`"), kind_of(df, name)
    if kind == "number":
        return c
    text = F.date_format(c, UNITS[unit]) if kind == "date" else F.when(c, "yes").when(~c, "no") if kind == "boolean" else c
    return F.coalesce(text, F.lit(MISSING))


def group(df: DataFrame, by: str, aggs: Sequence[Agg] = (Agg(),), unit: str = "month", names: Sequence[str] | None = None) -> DataFrame:
    """One row per group: ``key`` and the summaries, named by ``names`` or their labels."""
    names = names or [a.label() for a in aggs]
    keyed = df.withColumn("_key", group_key(df, by, unit))
    return summarised(keyed, ["_key"], aggs, names, df).withColumnRenamed("_key", "key")


def ordered(df: DataFrame, key: str, size: str, kind: str = "category", unit: str | None = None) -> DataFrame:
    """Rows of groups in their natural order, with their rank from 1 in ``rank``.

    Weekdays, months, quarters, ranges and year-months keep their order if all groups have such labels; numbers and
    dates ascend; other labels go by size. ``Other`` and then missing come last, but with weekdays of dates missing
    comes first. A job over the group labels decides which order holds. One row per group: the table is ranked in one
    task, as it is for display.
    """
    from pyspark.sql.window import Window as W

    k = F.col(key).cast("string")
    real = ~k.isin(MISSING, OTHER)
    tail = F.when(k == OTHER, 1).when(k.isNull() | (k == MISSING), 2).otherwise(0)
    place = lambda seq: F.array_position(F.array(*map(F.lit, seq)), k)
    if kind == "date" and unit == "weekday":
        by = [place(SEQUENCES[0])]
    elif kind in ("date", "number"):
        by = [tail, F.col(key).asc_nulls_last()]
    else:
        tests = [k.isin(*s) for s in SEQUENCES] + [k.rlike(RANGE), k.rlike(r"^\d{4}-\d{2}$")]
        found = df.where(real).agg(*[F.bool_and(t) for t in tests]).first()
        orders = [*[place(s) for s in SEQUENCES], F.regexp_extract(k, RANGE, 1).try_cast("double"), k]
        natural = next((o for ok, o in zip(found, orders, strict=True) if ok), None)
        by = [tail, natural] if natural is not None else [F.col(size).desc(), natural_key(k), k]
    return df.withColumn("rank", F.row_number().over(W.orderBy(*by)))


def frequencies(df: DataFrame, name: str) -> DataFrame:
    """(value, n) without nulls; ``first_frequencies`` orders it."""
    return df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").alias("value")).agg(F.count("*").alias("n"))


def first_frequencies(df: DataFrame, name: str, limit: int) -> DataFrame:
    """The most frequent values; ties in the order of their texts."""
    value = F.col("value").cast("string")
    return frequencies(df, name).orderBy(F.desc("n"), natural_key(value), value).limit(limit)


def pivot(df: DataFrame, rows: str, columns: str, agg: Agg = Agg(), row_unit: str = "month", column_unit: str = "month") -> DataFrame:
    """Cells and totals in one pass, long: row_key, col_key, level (cell, row, column, all) and value.

    Totals come from the rows themselves, so they hold for means and medians too.
    """
    keyed = df.withColumns({"_r": group_key(df, rows, row_unit).cast("string"), "_c": group_key(df, columns, column_unit).cast("string")})
    keyed = keyed.fillna(MISSING, ["_r", "_c"])
    if agg.fn == "median":
        held = keyed.select("_r", "_c", number(df, agg.column).alias("_y"))
        levels = F.array(*[F.struct((F.col("_r") if g < 2 else F.lit(None)).alias("_r"), (F.col("_c") if g % 2 == 0 else F.lit(None)).alias("_c"), F.lit(g).alias("g")) for g in range(4)])
        made = summarised(held.select("_y", F.inline(levels)), ["_r", "_c", "g"], [Agg("median", "_y")], ["value"])
    else:
        made = keyed.groupingSets([["_r", "_c"], ["_r"], ["_c"], []], "_r", "_c").agg(aggregate(df, agg).alias("value"), F.grouping_id().alias("g"))
    level = F.element_at(F.array(*map(F.lit, ("cell", "row", "column", "all"))), (F.col("g") + 1).cast("int"))
    return made.select(F.col("_r").alias("row_key"), F.col("_c").alias("col_key"), level.alias("level"), "value")


def pivot_wide(df: DataFrame, rows: str, columns: str, agg: Agg = Agg(), most: int = 25, **units: str) -> tuple[DataFrame, int]:
    """A row per row key with a column for each of the ``most`` largest column keys and ``Total``, a last row ``Total``,
    and the number of column keys left out (their rows still count in the totals)."""
    kind = kind_of(df, columns)
    keys = group(df, columns, unit=units.get("column_unit", "month"), names=["n"])
    total = keys.count()
    largest = keys.orderBy(F.desc("n"), F.col("key")).limit(most)
    shown = [r["key"] for r in ordered(largest, "key", "n", kind, units.get("column_unit")).orderBy("rank").collect()]
    labels = [MISSING if k is None else str(k) for k in shown]
    long = pivot(df, rows, columns, agg, **units)
    named = long.withColumn("row_key", F.coalesce("row_key", F.lit("Total"))).withColumn("col_key", F.coalesce("col_key", F.lit("Total")))
    wide = named.where(F.col("col_key").isin(*labels, "Total")).groupBy("row_key").pivot("col_key", [*labels, "Total"]).agg(F.first("value"))
    return wide, max(0, total - most)
