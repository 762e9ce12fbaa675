"""Natural groups of rows: k-means on a scattered sample, the number of groups by the silhouette, every row to its nearest centre.

The model is fitted to at most ``FIT_ROWS`` rows and ``FIT_COLUMNS`` columns, as its rules say; all rows of the table get a
label, by an expression. Random numbers come from a fixed sequence, so the same table always gives the same groups.

A row counts if half of its columns have values; others of its values are the sample's median. Rows that do not count
have no group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .cleaning import unique_name
from .sorting import ROW, scattered_sample, with_row_numbers
from .stats import num

FIT_ROWS, FIT_COLUMNS, LEAST_ROWS = 3000, 8, 12
#: Numbers of groups that are tried, rounds of k-means, points of the silhouette, and what a larger number must gain.
TRIED, ROUNDS, JUDGED, GAIN = (2, 3, 4, 5), 50, 600, 0.02
SEED = 7
# Words for how far a group's mean is from that of all, in standard deviations.
FAR, NEAR, WORDS = 1.0, 0.4, ("very low", "low", "high", "very high")


def uniform(seed: int) -> Callable[[], float]:
    """Random numbers from 0 to 1 by the Mulberry32 generator."""
    # Its step, and the shifts and bits of its two mixing rounds.
    step, rounds, last, mask = 0x6D2B79F5, ((15, 1), (7, 61)), 14, 0xFFFFFFFF
    state = seed & mask

    def draw() -> float:
        nonlocal state
        state = (state + step) & mask
        t = state
        for i, (shift, bits) in enumerate(rounds):
            mixed = (t ^ (t >> shift)) * (t | bits) & mask
            t = mixed if i == 0 else t ^ (t + mixed) & mask
        return ((t ^ (t >> last)) & mask) / 2**32

    return draw


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points (rows) to all centres (columns)."""
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def clustered(points: np.ndarray, k: int, draw: Callable[[], float]) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres). A first centre at random, each further one with odds by its squared distance to those before."""
    chosen = [int(draw() * len(points))]
    while len(chosen) < k:
        away = np.cumsum(squares(points, points[chosen]).min(axis=1))
        chosen.append(min(int(np.searchsorted(away, draw() * away[-1], "left")), len(points) - 1))
    centres, labels = points[chosen].copy(), np.zeros(len(points), np.int64)
    for turn in range(ROUNDS):
        found = squares(points, centres).argmin(axis=1)
        same, labels = bool((found == labels).all()), found
        for j in range(k):
            if (own := labels == j).any():
                centres[j] = points[own].mean(axis=0)
        if same and turn:
            break
    return labels, centres


def silhouette(points: np.ndarray, labels: np.ndarray, k: int) -> float:
    """How well the first points are separated, -1 to 1: the nearest other group's mean distance against the own one's."""
    p, of = points[:JUDGED], labels[:JUDGED]
    distance = np.sqrt(squares(p, p))
    member = np.eye(k)[of]
    sums, counts = distance @ member, np.tile(member.sum(axis=0), (len(p), 1))
    at = np.arange(len(p))
    counts[at, of] -= 1
    means = np.divide(sums, counts, out=np.full_like(sums, np.inf), where=counts > 0)
    own = np.where(counts[at, of] > 0, means[at, of], 0.0)
    means[at, of] = np.inf
    other = means.min(axis=1)
    most = np.maximum(own, other)
    with np.errstate(invalid="ignore", divide="ignore"):
        each = np.where(np.isinf(other), 0.0, (other - own) / most)
    return float(np.mean(each))


@dataclass(frozen=True)
class Groups:
    """A fitted model: columns with the sample's medians, means and deviations, and the centres in standard units, by the
    size of their group among all rows."""

    columns: list[str]
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    centres: np.ndarray
    score: float

    @property
    def quality(self) -> str:
        return "clearly separated" if self.score >= 0.5 else "reasonably separated" if self.score >= 0.25 else "overlapping"

    def nearest(self) -> Column:
        """The number of a row's group, from 1; null for a row that does not count."""
        values = [present(c) for c in self.columns]
        scaled = [(F.coalesce(v, F.lit(float(d))) - float(m)) / float(s) for v, d, m, s in zip(values, self.medians, self.means, self.deviations, strict=True)]
        distances = F.array(*[reduce(lambda a, b: a + b, [(x - float(c)) * (x - float(c)) for x, c in zip(scaled, centre, strict=True)]) for centre in self.centres])
        return F.when(counts(self.columns), F.array_position(distances, F.array_min(distances)).cast("int"))

    def labelled(self, df: DataFrame, name: str = "segment") -> DataFrame:
        return df.withColumn(unique_name(df.columns, name), self.nearest())

    def described(self, df: DataFrame) -> DataFrame:
        """(segment, size, share, name, means): each group with the two columns that set it apart most, in words."""
        held = self.labelled(df, "_segment").where(F.col("_segment").isNotNull())
        sizes = held.groupBy("_segment").agg(F.count("*").alias("n"), *[F.avg(present(c)).alias(f"m{i}") for i, c in enumerate(self.columns)]).collect()
        total, rows = sum(r["n"] for r in sizes), []
        for r in sorted(sizes, key=lambda r: r["_segment"]):
            means = [r[f"m{i}"] for i in range(len(self.columns))]
            z = [0.0 if m is None else (m - self.means[i]) / self.deviations[i] for i, m in enumerate(means)]
            order = sorted(range(len(z)), key=lambda i: -abs(z[i]))
            words = [f"{w} {self.columns[i]}" for i in order if (w := level(z[i]))][:2]
            rows.append((r["_segment"], r["n"], r["n"] / total, ", ".join(words) or "about average", means))
        return df.sparkSession.createDataFrame(rows, "segment int, size long, share double, name string, means array<double>")


def level(z: float) -> str | None:
    """How high a group's mean is; None for about average."""
    if abs(z) < NEAR:
        return None
    return (WORDS[0] if z <= -FAR else WORDS[1]) if z < 0 else WORDS[3] if z >= FAR else WORDS[2]


def present(c: str) -> Column:
    x = num(c)
    return F.when(~F.isnan(x), x)


def counts(columns: Sequence[str]) -> Column:
    """Whether a row has values in half of the columns."""
    filled = reduce(lambda a, b: a + b, [present(c).isNotNull().cast("int") for c in columns])
    return filled >= math.ceil(len(columns) / 2)


def fitted(df: DataFrame, columns: Sequence[str], k: int | None = None, order: Sequence[str] = ()) -> Groups:
    """The groups of a table by its first ``FIT_COLUMNS`` columns; ``k`` of them, or the best number of ``TRIED``.

    The sample is spread over row numbers, else over the order of the columns ``order``, else over that of hashes of the values (the
    values' own order would put like rows side by side, and the silhouette is taken of the first points). Its rows are not at even
    distances, as groups that take turns along the rows would then be missed.
    """
    columns = list(columns)[:FIT_COLUMNS]
    if len(columns) < 2:
        raise ValueError("Finding natural groups needs at least two number columns.")
    held = df.where(counts(columns))
    by = ["_old"] if ROW in df.columns else list(order) or ["_hash", *columns]
    slim = held.withColumnRenamed(ROW, "_old") if ROW in df.columns else held.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    slim = slim.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*by, *columns])])
    # rows that do not count have no number, so the others are numbered anew
    sample = scattered_sample(with_row_numbers(slim, *by), FIT_ROWS)
    rows = sample.orderBy(ROW).select(*[present(c) for c in columns]).collect()
    if len(rows) < LEAST_ROWS:
        raise ValueError("Finding natural groups needs at least 12 rows with numbers.")
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    means, medians = np.nanmean(x, axis=0), np.nanmedian(x, axis=0)
    n = np.maximum(1, (~np.isnan(x)).sum(axis=0) - 1)
    deviations = np.sqrt(np.nansum((x - means) ** 2, axis=0) / n)
    deviations[deviations == 0] = 1.0
    points = (np.where(np.isnan(x), medians, x) - means) / deviations
    draw, best = uniform(SEED), None
    for tried in [max(2, min(8, k))] if k else TRIED:
        if tried >= len(points) / 3:
            continue
        labels, centres = clustered(points, tried, draw)
        score = silhouette(points, labels, tried)
        if best is None or score > best[0] + GAIN:
            best = score, centres
    made = Groups(columns, medians, means, deviations, best[1], best[0])
    sizes = {r["g"]: r["n"] for r in held.groupBy(made.nearest().alias("g")).agg(F.count("*").alias("n")).collect()}
    by_size = sorted(range(len(best[1])), key=lambda g: -sizes.get(g + 1, 0))
    return Groups(columns, medians, means, deviations, best[1][by_size], best[0])

