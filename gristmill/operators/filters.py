"""Filters by kind of column. All given filters must hold; incomplete and unknown ones are ignored."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import RAW, kind_of, parse_boolean, parse_date, parse_number, text_of


@dataclass(frozen=True)
class Filter:
    """``op`` is one of the names below; ``value`` is text as a user types it."""

    column: str
    op: str
    value: object = None


_NUMBER = {
    "=": lambda c, v: c == v,
    "≠": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "≥": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "≤": lambda c, v: c <= v,
}
OPS = {
    "number": [*_NUMBER, "is missing", "is not missing"],
    "date": ["on", "before", "after", "is missing", "is not missing"],
    "boolean": ["is", "is missing", "is not missing"],
    "category": ["is", "is not", "contains", "is missing", "is not missing"],
    "text": ["contains", "does not contain", "is", "is missing", "is not missing"],
}


def constant(spark: SparkSession, value: Column) -> object:
    """Value of an expression without columns: folded by the optimizer, no job."""
    return spark.range(1).select(value.alias("v")).first()[0]


def predicate(df: DataFrame, f: Filter) -> Column | None:
    """Condition of one filter, or null if it is incomplete."""
    if f.column not in df.columns:
        return None
    c, kind, spark = F.col(f"`{f.column}`"), kind_of(df, f.column), df.sparkSession
    if f.op == "is missing":
        return c.isNull()
    if f.op == "is not missing":
        return c.isNotNull()
    typed = F.lit(None if f.value is None else str(f.value))
    if kind == "number":
        v = f.value if isinstance(f.value, int | float) and not isinstance(f.value, bool) else constant(spark, parse_number(typed))
        return None if v is None or f.op not in _NUMBER else _NUMBER[f.op](c, F.lit(v))
    if kind == "date":
        v = constant(spark, F.date_trunc("day", parse_date(typed)).cast("timestamp_ntz"))
        if v is None:
            return None
        day, after = F.lit(v), F.lit(v + dt.timedelta(days=1))
        return {"on": (c >= day) & (c < after), "before": c < day, "after": c >= after}.get(f.op)
    if kind == "boolean":
        v = constant(spark, parse_boolean(typed))
        return None if v is None else c == F.lit(v)
    needle = str("" if f.value is None else f.value).strip().lower()
    low = F.lower(c)
    return {
        "is": low == needle,
        "is not": F.coalesce(low != needle, F.lit(True)),
        "contains": low.contains(needle),
        "does not contain": F.coalesce(~low.contains(needle), F.lit(True)),
    }.get(f.op)


def where(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    found = [p for f in filters if (p := predicate(df, f)) is not None]
    return df.where(reduce(lambda a, b: a & b, found)) if found else df


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows in which the text of any column contains the query."""
    q = query.strip().lower()
    if not q:
        return df
    texts = [F.lower(text_of(df, c)).contains(q) for c in df.columns if c != RAW]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in texts]))
