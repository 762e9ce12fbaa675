"""Cleaning steps: each takes a frame and gives a frame; steps that need the data to decide a shape aggregate first."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.values import RAW, kind_of, marked, number_text, parse, round_digits, text_of, trimmed
from .quantiles import quantiles
from .sorting import ROW, in_ranges
from .summarize import OTHER, first_frequencies

MAX_PARTS, MAX_LABELS = 10, 200


class StepError(ValueError):
    """A step that cannot be applied, with a message for people."""


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (RAW, ROW)]


def put(df: DataFrame, name: str, value: Column, kind: str | None = None) -> DataFrame:
    """Replace or add a column; a text that it was read from no longer counts."""
    out = df.withColumn(name, marked(value, name, kind) if kind else value)
    if RAW in df.columns and name in df.schema[RAW].dataType.names:
        rest = [n for n in df.schema[RAW].dataType.names if n != name]
        out = out.withColumn(RAW, F.struct(*[F.col(RAW)[n].alias(n) for n in rest])) if rest else out.drop(RAW)
    return out


def new_name(df: DataFrame, name: str) -> str:
    name = name.strip()
    if not name:
        raise StepError("Give the new column a name.")
    if name in df.columns:
        raise StepError(f'There is already a column called "{name}".')
    return name


def unique_name(taken: Sequence[str], base: str) -> str:
    """Price, Price (2), Price (3) ..."""
    k, name = 1, base
    while name in taken:
        k, name = k + 1, f"{base} ({k + 1})"
    return name


def _repeat_key(df: DataFrame, columns: Sequence[str] | None) -> list[Column]:
    if columns:
        return [F.lower(trimmed(F.coalesce(text_of(df, c), F.lit("")))) for c in columns]
    return [text_of(df, c) for c in data_columns(df)]


def remove_duplicates(df: DataFrame, columns: Sequence[str] | None = None, row: str = ROW) -> DataFrame:
    """The first row of each group of equal rows: all columns exactly, or the given ones without case and outer blanks."""
    first = F.row_number().over(W.partitionBy(*_repeat_key(df, columns)).orderBy(row))
    return df.withColumn("_first", first).where("_first = 1").drop("_first")


def count_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(_repeat_key(df, columns))]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def drop_missing(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.dropna("any", subset=[column] if column else data_columns(df))


def fill(df: DataFrame, column: str, method: str, value: str | None = None) -> DataFrame:
    """Fill missing values by mean, median, mode or a given value (``fill_previous`` is its own step)."""
    c, kind = F.col(f"`{column}`"), kind_of(df, column)
    if method in ("mean", "median"):
        if kind != "number":
            raise StepError(f"Filling with the {method} only works for number columns.")
        if method == "mean":
            made = df.agg(F.avg(c.cast("double")).alias("v"))
        else:
            made = quantiles(df, [], c.cast("double")).select(F.col("q")[0].alias("v"))
        found = next((r[0] for r in made.select(round_digits(F.col("v"))).collect()), None)
    elif method == "mode":
        top = first_frequencies(df, column, 1).first()
        found = top["value"] if top else None
    else:
        if value is None or not value.strip():
            raise StepError("Type the value to fill in.")
        found = df.sparkSession.range(1).select(parse(F.lit(value), kind).alias("v")).first()[0]
        if found is None:
            raise StepError(f'"{value}" isn\'t a valid {kind} for {column}.')
    if found is None:
        raise StepError(f"{column} has no values to learn a fill value from.")
    return put(df, column, F.coalesce(c, F.lit(found)))


def fill_previous(df: DataFrame, column: str, row: str = ROW) -> DataFrame:
    """Each missing value takes the last one before it in row order; leading gaps stay.

    The rows are dealt by ranges of ``row``; each range's last value is carried into the later ones, so no task holds
    the whole table.
    """
    c = F.col(f"`{column}`")
    ranged = in_ranges(df, [F.col(row)])
    last = ranged.groupBy("_part").agg(F.max_by(c, F.when(c.isNotNull(), F.col(row))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    into = last.select(F.col("_part").alias("_p"), carried.alias("_carry"))
    own = F.last(c, ignorenulls=True).over(W.partitionBy("_part").orderBy(row).rowsBetween(W.unboundedPreceding, 0))
    joined = ranged.withColumn("_own", own).join(into, F.col("_part") == F.col("_p"), "left")
    return put(joined, column, F.coalesce("_own", "_carry")).drop("_part", "_p", "_own", "_carry")


def title_case(c: Column) -> Column:
    """Capital after start, white space, - _ and /."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\s\-_/]+|[^\s\-_/]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def change_text(df: DataFrame, column: str, how: str) -> DataFrame:
    c = F.col(f"`{column}`")
    made = {"trim": F.regexp_replace(trimmed(c), r"(?U)\s+", " "), "lower": F.lower(c), "upper": F.upper(c), "title": title_case(c)}
    return put(df, column, made[how])


def replace(df: DataFrame, column: str, find: str, with_: str, whole: bool = False, match_case: bool = False) -> DataFrame:
    """Replace a text in cells, or whole cells; the replacement is literal."""
    c = F.col(f"`{column}`")
    if whole:
        a, b = trimmed(c), F.lit(find.strip())
        return put(df, column, F.when(a == b if match_case else F.lower(a) == F.lower(b), F.lit(with_)).otherwise(c))
    if match_case:
        return put(df, column, F.replace(c, F.lit(find), F.lit(with_)))
    quoted = "(?iu)" + r"\Q" + find.replace(r"\E", r"\E\\E\Q") + r"\E"
    return put(df, column, F.regexp_replace(c, quoted, with_.replace("\\", "\\\\").replace("$", "\\$")))


def standardize(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Rename exact values; the map is part of the step."""
    c = F.col(f"`{column}`")
    if not names:
        return df
    return put(df, column, F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c], c))


def split(df: DataFrame, column: str, by: str) -> DataFrame:
    """Pieces of a text in new columns ``name 1`` ..., at most 10; the last keeps the rest."""
    c = F.col(f"`{column}`")
    quoted = r"\Q" + by.replace(r"\E", r"\E\\E\Q") + r"\E"
    most = df.agg(F.max(F.size(F.split(c, quoted, MAX_PARTS)))).first()[0] or 0
    if most < 2:
        raise StepError(f'No value of {column} contains "{by}".')
    parts = F.split(c, quoted, most)
    out, names = df, list(df.columns)
    for i in range(most):
        name = unique_name(names, f"{column} {i + 1}")
        names.insert(names.index(column) + 1 + i, name)
        piece = trimmed(F.get(parts, F.lit(i)))
        out = out.withColumn(name, marked(F.when(piece != "", piece), name, "category"))
    return out.select(*[F.col(f"`{n}`") for n in names])


def nice_bin(low: float, high: float, target: int = 6) -> float:
    """1, 2, 2.5, 5 or 10 times a power of ten, at least a ``target``-th of the span."""
    span = high - low
    if span <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(span / target))
    return next((m * power for m in (1, 2, 2.5, 5, 10) if m * power >= span / target), 10 * power)


def bin_label(c: Column, size: float, start: float) -> Column:
    k = F.floor((c - start) / size + 1e-9)
    return F.concat(number_text(F.lit(start) + k * size), F.lit(" – "), number_text(F.lit(start) + (k + 1) * size))


def group_ranges(df: DataFrame, column: str, name: str, size: float | None = None) -> DataFrame:
    """A label of the range that a number falls into."""
    c = F.col(f"`{column}`").cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    if low is None:
        raise StepError(f"{column} has no numbers.")
    size = size or nice_bin(low, high)
    return put(df, new_name(df, name), bin_label(c, size, math.floor(low / size) * size), "category")


def group_top(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, others as ``Other``, missing ones missing. ``n`` bounds what is sent out."""
    c = F.col(f"`{column}`")
    keep = [r["value"] for r in first_frequencies(df, column, n).collect()]
    return put(df, new_name(df, name), F.when(c.isin(*keep), c).when(c.isNotNull(), OTHER), "category")


DATE_PARTS = {
    "year": lambda c: F.year(c).cast("double"),
    "quarter": lambda c: F.concat(F.lit("Q"), F.quarter(c).cast("string")),
    "month": lambda c: F.date_format(c, "MMM"),
    "yearMonth": lambda c: F.date_format(c, "yyyy-MM"),
    "weekday": lambda c: F.date_format(c, "EEE"),
    "day": lambda c: F.dayofmonth(c).cast("double"),
}


def date_part(df: DataFrame, column: str, part: str, name: str) -> DataFrame:
    made = DATE_PARTS[part](F.col(f"`{column}`"))
    return put(df, new_name(df, name), made, "number" if part in ("year", "day") else "category")


def rename(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rename a column, its text too."""
    name = new_name(df, name) if name.strip() != column else column
    out = df.withColumnRenamed(column, name)
    if RAW in df.columns and column in df.schema[RAW].dataType.names:
        fields = [F.col(RAW)[n].alias(name if n == column else n) for n in df.schema[RAW].dataType.names]
        out = out.withColumn(RAW, F.struct(*fields))
    return out


def delete(df: DataFrame, column: str) -> DataFrame:
    if len(data_columns(df)) < 2:
        raise StepError("A table needs at least one column.")
    return df.drop(column)


def set_kind(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Read the column's text anew as another kind, which it keeps when the table is joined or stacked."""
    text = text_of(df, column)
    return df.withColumn(column, parse(text, kind).alias(column, metadata={"kind": kind, "chosen": True}))


def unpivot(df: DataFrame, columns: Sequence[str], name_column: str, value_column: str) -> DataFrame:
    """Wide to long, missing values too; values keep their type if all agree, else they are texts."""
    if len(columns) < 2:
        raise StepError("Choose at least two columns.")
    rest = [c for c in df.columns if c not in columns and c != RAW]
    if len({df.schema[c].dataType for c in columns}) > 1:
        df = df.select(*rest, *[text_of(df, c).alias(c) for c in columns])
    return df.unpivot(rest, list(columns), name_column, value_column)


def widen(df: DataFrame, labels: str, values: str, mean: bool = False, row: str | None = None) -> DataFrame:
    """Long to wide: a column per label; numbers sum (or average), other values take the first in row order."""
    keys = [c for c in data_columns(df) if c not in (labels, values)]
    label = text_of(df, labels)
    first_seen = F.min(row) if row else F.min(label)
    found = df.where(F.col(f"`{labels}`").isNotNull()).groupBy(label.alias("l")).agg(first_seen.alias("o")).orderBy("o", "l").limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise StepError(f"{labels} has more than {MAX_LABELS} values.")
    number = kind_of(df, values) == "number"
    v = F.col(f"`{values}`")
    agg = (F.avg(v) if mean else F.sum(v)) if number else F.min_by(v, F.when(v.isNotNull(), F.col(row) if row else v))
    return df.withColumn("_label", label).groupBy(*keys).pivot("_label", [r["l"] for r in found]).agg(agg)
