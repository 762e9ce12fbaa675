"""Sorting, pages and evenly spaced samples."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.values import kind_of, natural_key
from .storage import saved

ROW = "_rid"


def with_row_numbers(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with dense row numbers from 0 in ``_rid``, in the order of ``order`` (unique together).

    Rows are dealt by range and written with the number of their range, so that it is the same wherever it is read;
    numbers within a range plus the sizes of those before it are enough, and no task holds the whole table.
    """
    return numbered(df, [F.col(f"`{c}`") for c in order])


def numbered(df: DataFrame, by: list[Column]) -> DataFrame:
    """``with_row_numbers`` in the order of expressions."""
    ranged = in_ranges(df, by)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_p"), before.alias("_start"))
    local = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*by)))
    joined = local.join(starts, F.col("_part") == F.col("_p"))
    return joined.withColumn(ROW, F.col("_start") + F.col("_n") - 1).drop("_part", "_p", "_n", "_start")


def in_ranges(df: DataFrame, by: list[Column]) -> DataFrame:
    """``df`` dealt by ranges of ``by`` with ``_part``, the number of a row's range.

    It is written once: dealt again, the ranges would be cut at other places.
    """
    return saved(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))


def running_totals(df: DataFrame, by: list[Column], value: str) -> DataFrame:
    """``df`` with ``running``, the sum of ``value`` up to each row in the order ``by`` (unique), and ``total``.

    As with row numbers, only the sums of the ranges are summed in one task.
    """
    ranged = in_ranges(df, by)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select(F.col("_part").alias("_p"), before.alias("_start"), F.sum("_sum").over(W.partitionBy()).alias("total"))
    local = ranged.withColumn("_own", F.sum(value).over(W.partitionBy("_part").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)))
    joined = local.join(starts, F.col("_part") == F.col("_p"))
    return joined.withColumn("running", F.col("_start") + F.col("_own")).drop("_part", "_p", "_own", "_start")


def keyed(df: DataFrame, column: str, descending: bool, tie: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with the sort key of a column in ``_sort_key``, so that it is made once a row and not at each comparison, and
    the order by it."""
    c = F.col(f"`{column}`")
    made = df.withColumn("_sort_key", natural_key(c) if kind_of(df, column) in ("category", "text") else c)
    key = F.col("_sort_key")
    return made, [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(tie)]


def sort(df: DataFrame, column: str, descending: bool = False, tie: str = ROW) -> DataFrame:
    """Missing values last either way; ties in row order either way; texts in natural order."""
    made, by = keyed(df, column, descending, tie)
    return made.orderBy(*by).drop("_sort_key")


def ranked(df: DataFrame, column: str, descending: bool = False, tie: str = ROW) -> DataFrame:
    """``df`` with ``rank``, the place from 1 of each row in the order of ``sort``; no task holds all rows."""
    made, by = keyed(df, column, descending, tie)
    return numbered(made, by).withColumn("rank", F.col(ROW) + 1).drop(ROW, "_sort_key")


def top(df: DataFrame, column: str, n: int, descending: bool = True, tie: str | None = None) -> DataFrame:
    c = F.col(f"`{column}`")
    more = [F.col(f"`{tie}`")] if tie else []
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *more).limit(n)


@dataclass(frozen=True)
class Pages:
    """An ordered table kept by ranges with an index of them, so that any page is found in few of its files.

    ``table`` has the rows with ``_part``, the number of their range (a folder each), and ``_n``, their place in it from 0.
    ``starts`` has the number of rows before each range, and after the last; there are as many ranges as shuffle partitions.
    """

    table: DataFrame
    by: list[Column]
    starts: list[int]
    parts: list[int]

    def page(self, number: int, size: int = 50) -> DataFrame:
        """Page ``number`` from 0, in order. Only the ranges that hold its rows are read, and of them only its rows are sorted."""
        low, high = number * size, min((number + 1) * size, self.starts[-1])
        wanted = [k for k in range(len(self.parts)) if self.starts[k] < high and self.starts[k + 1] > low]
        place = [F.when(F.col("_part") == self.parts[k], F.col("_n") + self.starts[k]) for k in wanted]
        at = F.coalesce(*place, F.lit(-1))
        rows = self.table.where(F.col("_part").isin([self.parts[k] for k in wanted]))
        if wanted:  # reaches the scan, unlike the place
            rows = rows.where((F.col("_n") >= max(low - self.starts[wanted[-1]], 0)) & (F.col("_n") < max(high - self.starts[k] for k in wanted)))
        return rows.where((at >= low) & (at < high)).orderBy("_part", "_n").drop("_part", "_n")


def paged(df: DataFrame, column: str, descending: bool = False, tie: str = ROW, ranges: int | None = None) -> Pages:
    """``df`` in the order of ``sort``, written once by ranges (as many as Spark finds fit, if not given). All have about as
    many rows, so a page reads one or two."""
    made, by = keyed(df, column, descending, tie)
    dealt = made.repartitionByRange(ranges, *by) if ranges else made.repartitionByRange(*by)
    held = dealt.sortWithinPartitions(*by)
    held = held.drop("_sort_key").withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    table = saved(held, "_part")
    sizes = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(sizes)
    return Pages(table, by, list(itertools.accumulate((sizes[p] for p in parts), initial=0)), parts)


def even_sample(df: DataFrame, n: int, row: str = ROW) -> DataFrame:
    """Exactly min(n, all) rows at even distances by their dense row number; always the same ones."""
    total = df.agg(F.max(row)).first()[0]
    if total is None or total + 1 <= n:
        return df
    total += 1
    r = F.col(row)
    # row floor(k * total / n) of some k < n: k must be ceil(r * n / total)
    k = F.ceil(r * F.lit(n) / F.lit(total) - F.lit(1e-9)).cast("long")
    return df.where((F.floor(k * F.lit(total) / F.lit(n)) == r) & (k < n))


def scattered_sample(df: DataFrame, n: int, row: str = ROW) -> DataFrame:
    """Exactly min(n, all) rows by their dense row number, one from each of ``n`` stretches of equal length; always the same ones.

    Its place in the stretch is told by a hash of the stretch's number, so a pattern that repeats along the rows is met at all
    its places, whatever its period; at even distances, a period that divides them is met at one place only.
    """
    total = df.agg(F.max(row)).first()[0]
    if total is None or total + 1 <= n:
        return df
    total += 1
    held = df.withColumn("_k", F.expr(f"((`{row}` + 1) * {n}L - 1) div {total}L"))
    held = held.withColumns({"_low": F.expr(f"(_k * {total}L) div {n}L"), "_high": F.expr(f"((_k + 1) * {total}L) div {n}L")})
    return held.where(F.col(row) == F.col("_low") + F.pmod(F.xxhash64("_k"), F.col("_high") - F.col("_low"))).drop("_k", "_low", "_high")
