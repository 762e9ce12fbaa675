"""Joins in which one key may hold a large part of a side.

Keys of very many rows are found by a frequent-items summary (bounded, merged over tasks) and counted exactly. Their rows are
dealt in a grid: a side's rows of such a key go to as many pieces as they are times ``PIECE``, and each piece meets
each piece of the other side once. All other rows are joined as usual. Spark's own splitting of skewed partitions does not
reach full joins, nor the right side of left ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Least share of a side's rows that the summary looks for, and rows of a piece.
SHARE, PIECE = 1 / 128, 1 << 20


def frequent(df: DataFrame, key: str, share: float = SHARE) -> list[str]:
    """All keys with at least ``share`` of the rows, and perhaps others; 1 / share at most."""
    found = df.where(F.col(key).isNotNull()).select(key).stat.freqItems([key], share).first()[0]
    return sorted(k for k in found or [] if k is not None)


def counts_of(df: DataFrame, key: str, keys: list[str]) -> dict[str, int]:
    if not keys:
        return {}
    return {r["k"]: r["n"] for r in df.where(F.col(key).isin(keys)).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).collect()}


def dealt(df: DataFrame, key: str, own: dict[str, int], other: dict[str, int], names: tuple[str, str]) -> DataFrame:
    """Rows of heavy keys with the number of their piece, once for each piece of the other side."""
    of = lambda pieces: F.create_map(*[F.lit(x) for k, n in pieces.items() for x in (k, n)])[F.col(key)]
    placed = df.withColumn(names[0], (F.monotonically_increasing_id() % of(own)).cast("int"))
    return placed.withColumn(names[1], F.explode(F.sequence(F.lit(0), of(other) - 1)))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, piece: int = PIECE) -> DataFrame:
    """Left, inner or full join of sides without common column names. The keys are texts; null keys never match.

    No task gets more than about ``piece`` rows of a key from each side, if keys below ``SHARE`` of their side have fewer.
    """
    on = F.col(left_key) == F.col(right_key)
    keys = sorted({*frequent(left, left_key), *frequent(right, right_key)})
    a, b = counts_of(left, left_key, keys), counts_of(right, right_key, keys)
    heavy = [k for k in keys if max(a.get(k, 0), b.get(k, 0)) > piece]
    if not heavy:
        return left.join(right, on, how)
    within: Column = F.col(left_key).isin(heavy)
    inside: Column = F.col(right_key).isin(heavy)
    rest = lambda c: ~F.coalesce(c, F.lit(False))
    parts = [left.where(rest(within)).join(right.where(rest(inside)), on, how)]
    both = [k for k in heavy if k in a and k in b]
    if both:
        pieces = lambda n: {k: -(-n[k] // piece) for k in both}
        x = dealt(left.where(F.col(left_key).isin(both)), left_key, pieces(a), pieces(b), ("_la", "_lb"))
        y = dealt(right.where(F.col(right_key).isin(both)), right_key, pieces(b), pieces(a), ("_rb", "_ra"))
        parts.append(x.join(y, on & (F.col("_la") == F.col("_ra")) & (F.col("_lb") == F.col("_rb"))).drop("_la", "_lb", "_ra", "_rb"))
    # a heavy key that the other side does not have matches nothing
    if how != "inner":
        parts.append(left.where(F.col(left_key).isin([k for k in heavy if k not in b])))
    if how == "full":
        parts.append(right.where(F.col(right_key).isin([k for k in heavy if k not in a])))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
