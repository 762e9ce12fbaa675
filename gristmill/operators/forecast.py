"""Forecasts of series by exponential smoothing with a damped trend and, for enough points, a repeating pattern.

A series has a row per bucket, so it is short; a table of many series is dealt by series and each is fitted in one
call. All settings of the grid are run side by side as arrays, one step a point.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .series import regular

# The settings that are tried, the half-width of an 80 % interval, usual horizons.
ALPHAS, BETAS, PHIS, GAMMAS = (0.05, 0.15, 0.3, 0.5, 0.7, 0.9), (0.01, 0.05, 0.15, 0.3), (0.9, 0.98), (0.05, 0.15, 0.3)
Z80 = 1.2816
HORIZONS = {"day": 30, "month": 6, "year": 3}
LEAST_POINTS, MOST_GAPS = 8, 0.3


def season_length(unit: str, points: int) -> int:
    """A week of days, a year of months, or 0."""
    return 7 if unit == "day" and points >= 21 else 12 if unit == "month" and points >= 24 else 0


@dataclass
class Fitted:
    """The best setting with its state after the last point."""

    level: float
    trend: float
    season: np.ndarray  # the last cycle
    alpha: float
    beta: float
    phi: float
    sigma: float

    def ahead(self, horizon: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and deviations of the next points."""
        h = np.arange(1, horizon + 1)
        value = self.level + np.cumsum(self.phi**h) * self.trend
        if len(self.season):
            value = value + self.season[(h - 1) % len(self.season)]
        a, b = self.alpha, self.beta
        growth = 1 + (h - 1) * a * a * (1 + h * b + h * (2 * h - 1) * b * b / 6)
        return value, self.sigma * np.sqrt(growth)


def fit(y: np.ndarray, cycle: int) -> Fitted:
    """The setting with the least squared one-step errors; the first of equals."""
    grid = np.array(list(itertools.product(ALPHAS, BETAS, PHIS, GAMMAS if cycle else (0.0,))))
    alpha, beta, phi, gamma = grid.T
    if cycle:
        first, second = y[:cycle].mean(), y[cycle : 2 * cycle].mean()
        level, trend = np.full(len(grid), first), np.full(len(grid), (second - first) / cycle)
        season = np.tile((y[:cycle] - first)[:, None], (1, len(grid)))
    else:
        level, trend, season = np.full(len(grid), y[0]), np.full(len(grid), y[1] - y[0]), np.zeros((1, len(grid)))
    errors = np.zeros(len(grid))
    start = cycle or 1
    for t in range(start, len(y)):
        own = season[t % cycle] if cycle else 0.0
        drift = level + phi * trend
        errors += (y[t] - drift - own) ** 2
        new = alpha * (y[t] - own) + (1 - alpha) * drift
        trend = beta * (new - level) + (1 - beta) * phi * trend
        level = new
        if cycle:
            season[t % cycle] = gamma * (y[t] - level) + (1 - gamma) * own
    k = int(np.argmin(errors))
    last = np.roll(season[:, k], -(len(y) % cycle)) if cycle else np.zeros(0)
    return Fitted(level[k], trend[k], last, alpha[k], beta[k], phi[k], float(np.sqrt(errors[k] / max(1, len(y) - start))))


@dataclass
class Forecast:
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cycle: int
    total: tuple[float, float, float]  # the sum of the points, and its interval
    error: float | None  # mean absolute error over the last points, forecast from those before them
    share: float | None  # the same as a share of their size


def forecast(y: np.ndarray, unit: str, horizon: int) -> Forecast:
    """The next ``horizon`` points of a regular series; never below 0 if no point is."""
    floor = 0.0 if (y >= 0).all() else -np.inf
    cycle = season_length(unit, len(y))
    value, deviation = fit(y, cycle).ahead(horizon)
    error = share = None
    hidden = min(horizon, len(y) // 3)
    if hidden >= 2 and len(y) - hidden >= max(8, 2 * (cycle or 1)):
        known, actual = y[:-hidden], y[-hidden:]
        guess = np.maximum(fit(known, season_length(unit, len(known))).ahead(hidden)[0], floor)
        error = float(np.abs(actual - guess).mean())
        size = np.abs(actual).mean()
        share = error / size if size else None
    low, high = value - Z80 * deviation, value + Z80 * deviation
    points = np.maximum(value, floor)
    whole = float(points.sum())
    spread = Z80 * float(np.sqrt((deviation**2).sum()))  # errors of the points are taken as independent
    total = (whole, max(whole - spread, floor), whole + spread)
    return Forecast(points, np.maximum(low, floor), np.maximum(high, floor), cycle, total, error, share)


AHEAD = "at timestamp_ntz, y double, low double, high double, cycle int, error double"
TOTAL = "horizon int, total double, total_low double, total_high double, average double, error double, error_share double, filled long"


def forecasts(series: DataFrame, unit: str, horizon: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, at, y, low, high, cycle, error) for the buckets after each series.

    Series of fewer than eight points, or of which over 30 % had to be filled, have no forecast.
    """
    steps = horizon or HORIZONS[unit]

    def rows(found: Forecast, last: pd.Timestamp, filled: int) -> dict:
        at = [last + pd.DateOffset(**{f"{unit}s": h}) for h in range(1, steps + 1)]
        return {"at": at, "y": found.value, "low": found.low, "high": found.high, "cycle": found.cycle, "error": found.error}

    return _each(series, unit, steps, keys, AHEAD, rows)


def forecast_totals(series: DataFrame, unit: str, horizon: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, horizon, total, total_low, total_high, average, error, error_share, filled) of each series: the sum of its forecast
    with the interval that four of five sums lie in, their average, how far off a forecast of the last points was, and how
    many gaps were filled."""
    steps = horizon or HORIZONS[unit]

    def rows(found: Forecast, last: pd.Timestamp, filled: int) -> dict:
        total, low, high = found.total
        made = (steps, total, low, high, total / steps, found.error, found.share, filled)
        return {n: [v] for n, v in zip((f.split()[0] for f in TOTAL.split(", ")), made, strict=True)}

    return _each(series, unit, steps, keys, TOTAL, rows)


def _each(series: DataFrame, unit: str, horizon: int, keys: Sequence[str], ddl: str, rows: Callable[[Forecast, pd.Timestamp, int], dict]) -> DataFrame:
    """What ``rows`` makes of the forecast of each series that can have one."""
    whole = regular(series.where(F.col("y").isNotNull()), unit, keys)
    if not keys:
        whole = whole.withColumn("_all", F.lit(0))
    by = list(keys) or ["_all"]
    schema = T.StructType([*[f for f in whole.schema.fields if f.name in by], *T.StructType.fromDDL(ddl).fields])

    def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        if (~pdf["filled"]).sum() < LEAST_POINTS or pdf["filled"].mean() > MOST_GAPS:
            return pd.DataFrame(columns=schema.names)
        found = forecast(pdf["y"].to_numpy(dtype=float), unit, horizon)
        made = pd.DataFrame(rows(found, pd.Timestamp(pdf["at"].iloc[-1]), int(pdf["filled"].sum())))
        return made.assign(**{k: pdf[k].iloc[0] for k in by})[schema.names]

    out = whole.groupBy(*by).applyInPandas(ahead, schema)
    return out if keys else out.drop("_all")
