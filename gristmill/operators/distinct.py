"""Numbers of different values of many columns at once, without a copy of the rows for each column.

Each task keeps a set of values for each column and gives it up when it passes a limit; the sets of tasks are merged. Only
columns beyond the limit are counted by grouping, if their exact number is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .storage import saved

#: Different values of a column that a task keeps.
LIMIT = 1000


@dataclass(frozen=True)
class Count:
    """Missing values and different others of a column; ``values`` is a lower bound if not ``exact``."""

    missing: int
    values: int
    exact: bool


def value_key(df: DataFrame, name: str) -> Column:
    """A text that is equal for equal values of a column: zeros of both signs are, and instants whatever the zone."""
    c, t = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(t, T.DoubleType | T.FloatType):
        return (c + F.lit(0.0)).cast("string")
    return (F.unix_micros(c) if isinstance(t, T.TimestampType) else c).cast("string")


def bounded(df: DataFrame, columns: Sequence[str], limit: int = LIMIT) -> dict[str, Count]:
    """Counts of all columns from one pass; exact for those of which no task saw more than ``limit`` values."""
    if not columns:
        return {}
    keys = df.select(*[value_key(df, c).alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[set | None] = [set() for _ in columns]
        missing = [0] * len(columns)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                missing[i] += column.null_count
                if (held := sets[i]) is not None:
                    held.update(pc.unique(column.drop_null()).to_pylist())
                    if len(held) > limit:
                        sets[i] = None
        made = [range(len(columns)), missing, [s is None for s in sets], [list(s or ()) for s in sets]]
        types = (pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=["i", "missing", "over", "held"])

    parts = saved(keys.mapInArrow(run, "i int, missing long, over boolean, held array<string>"))
    sums = {r["i"]: r for r in parts.groupBy("i").agg(F.sum("missing").alias("missing"), F.bool_or("over").alias("over")).collect()}
    merged = parts.select("i", F.explode("held").alias("v")).distinct().groupBy("i").agg(F.count("*").alias("n"))
    found = {r["i"]: r["n"] for r in merged.collect()}
    at_least = lambda i: max(found.get(i, 0), limit + 1 if sums[i]["over"] else 0)
    return {c: Count(sums[i]["missing"], at_least(i), not sums[i]["over"]) if i in sums else Count(0, 0, True) for i, c in enumerate(columns)}


def exact(df: DataFrame, columns: Sequence[str], limit: int = LIMIT) -> dict[str, Count]:
    """Exact counts of all columns: those beyond the limit are stacked, grouped by value and counted."""
    found = bounded(df, columns, limit)
    more = [c for c in columns if not found[c].exact]
    if more:
        each = F.array(*[F.struct(F.lit(i).alias("i"), value_key(df, c).alias("v")) for i, c in enumerate(more)])
        values = df.select(F.inline(each)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.lit(1))
        for r in values.groupBy("i").agg(F.count("*").alias("n")).collect():
            found[more[r["i"]]] = Count(found[more[r["i"]]].missing, r["n"], True)
    return found
