"""Exact quantiles of columns and of groups, with no task holding a column's or a group's values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .sorting import in_ranges

QUARTERS = (0.25, 0.5, 0.75)


def same_keys(keys: Sequence[str], suffix: str) -> Column:
    """Condition of a join of key columns with their copies, nulls being equal."""
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}{suffix}`")) for k in keys], F.lit(True))


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, points: Sequence[float] = (0.5,)) -> DataFrame:
    """(*keys, q): an array of the ``points`` of each group, linear between neighbours; nulls do not count.

    Equal values are counted first. The counts are dealt by ranges of (keys, value) and only the sums of the ranges are
    summed in one task, so the two values that a point lies between are found by their rank.
    """
    named = [F.col(f"`{k}`") for k in keys]
    counts = df.select(*named, value.cast("double").alias("_x")).where("_x IS NOT NULL").groupBy(*named, "_x").agg(F.count("*").alias("_n"))
    ranged = in_ranges(counts, [*named, F.col("_x")])
    sizes = ranged.groupBy("_part", *named).agg(F.sum("_n").alias("_size"))
    whole = W.partitionBy(*named)
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(
        F.col("_part").alias("_p"), *[c.alias(f"{k}_of") for c, k in zip(named, keys, strict=True)], before.alias("_start"), F.sum("_size").over(whole).alias("_all")
    )
    local = ranged.withColumn("_own", F.sum("_n").over(W.partitionBy("_part", *named).orderBy("_x")))
    joined = local.join(starts, (F.col("_part") == F.col("_p")) & same_keys(keys, "_of"))
    end = F.col("_start") + F.col("_own")
    at = lambda k: F.max(F.when((k >= end - F.col("_n")) & (k < end), F.col("_x")))
    ends = []
    for i, p in enumerate(points):
        low = F.floor(F.lit(p) * (F.col("_all") - 1))
        ends += [at(low).alias(f"_low{i}"), at(F.least(low + 1, F.col("_all") - 1)).alias(f"_high{i}")]
    made = joined.groupBy(*named).agg(F.max("_all").alias("_all"), *ends)
    out = []
    for i, p in enumerate(points):
        place = F.lit(p) * (F.col("_all") - 1)
        share = place - F.floor(place)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append(F.when(low == high, low).otherwise((1 - share) * low + share * high))
    return made.select(*named, F.array(*out).alias("q"))


def of_columns(df: DataFrame, columns: dict[str, Column], points: Sequence[float] = QUARTERS) -> dict[str, list[float]]:
    """The ``points`` of each column that has values; the columns are ranked together, as groups of one long column."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("_i"), c.cast("double").alias("_v")) for i, c in enumerate(columns.values())])
    found = {r["_i"]: list(r["q"]) for r in quantiles(df.select(F.inline(pairs)), ["_i"], F.col("_v"), points).collect()}
    return {c: found[i] for i, c in enumerate(columns) if i in found}
