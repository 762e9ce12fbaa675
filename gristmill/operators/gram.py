"""Correlations of all pairs of many columns: matrix products within tasks, summed over tasks.

A block of columns and its mask of present values give, by five products, the sums that every pair's complete rows need.
Values are taken from their columns' means first, so that the sums do not cancel. Tables of more than ``BLOCK`` columns are
taken two blocks at a time; a scan reads only the columns of its two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stats import num

BLOCK = 512
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, cx, cy) of each pair i < j of columns over the rows that have both: sums of differences
    from cx and cy. A task gives a row a pair, whatever its rows; there are about as many tasks as cores."""
    means = df.agg(*[F.avg(F.when(~F.isnan(num(c)), num(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    edges = [range(a, min(a + block, len(columns))) for a in range(0, len(columns), block)]
    parts = [_block(df, columns, centre, x, y) for k, x in enumerate(edges) for y in edges[k:]]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sums = whole.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS], F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    return sums


def _block(df: DataFrame, columns: Sequence[str], centre: np.ndarray, first: range, second: range) -> DataFrame:
    at = [*first, *(second if second != first else [])]
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    held = df.select(*[num(columns[i]).alias(f"c{i}") for i in at]).coalesce(tasks)
    x, y = slice(0, len(first)), slice(0, len(first)) if second == first else slice(len(first), len(at))
    i, j = (g.ravel() for g in np.meshgrid(np.array(first), np.array(second), indexing="ij"))
    upper = i < j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(SUMS), len(first), len(second)))
        for batch in batches:
            has = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            v = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns]) - centre[at]
            v *= has
            a, b, p, q = v[:, x], v[:, y], has[:, x], has[:, y]
            sums += [p.T @ q, a.T @ q, p.T @ b, (a * a).T @ q, p.T @ (b * b), a.T @ b]
        flat = [s.ravel()[upper] for s in sums]
        made = [i[upper], j[upper], *flat, centre[i[upper]], centre[j[upper]]]
        yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=names)

    names = ["i", "j", *SUMS, "cx", "cy"]
    return held.mapInArrow(run, "i long, j long, " + ", ".join(f"{s} double" for s in (*SUMS, "cx", "cy")))


def correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(x, y, r) for each pair of columns, in their order; null with fewer than 3 complete rows or without variance."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    n = F.nullif(F.col("n"), F.lit(0.0))
    spread = lambda s, q: F.col(q) / n - (F.col(s) / n) * (F.col(s) / n)
    vx, vy = spread("sx", "sxx"), spread("sy", "syy")
    # what is left of a constant column is the rounding of its mean
    varied = lambda v, c: v > F.col(c) * F.col(c) * 1e-24
    r = F.try_divide(F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n), F.sqrt(vx) * F.sqrt(vy))
    names = F.array(*[F.lit(c) for c in columns])
    made = pair_sums(df, columns, block).withColumn("r", F.when((n >= 3) & varied(vx, "cx") & varied(vy, "cy"), r))
    return made.select(F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), "r")
