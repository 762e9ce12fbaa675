"""Series: averages of neighbours, running shares, unusual days, gaps, forecasts."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import forecast, series
from .registry import query, table

_DAYS = "SELECT date_trunc('day', ts) AS \"at\", sum(value) AS y FROM events GROUP BY 1"


def days(spark: SparkSession, sf: str) -> DataFrame:
    return series.totals(table(spark, sf, "events"), "ts", "value", "day")


@query("series_totals", f"SELECT CAST(\"at\" AS TIMESTAMP) AS \"at\", round(y, 4) AS y FROM ({_DAYS})")
def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return days(spark, sf).withColumn("y", F.round("y", 4))


@query(
    "moving_average",
    f"SELECT CAST(\"at\" AS TIMESTAMP) AS \"at\", round(avg(y) OVER (ORDER BY \"at\" ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS smooth FROM ({_DAYS})",
)
def _smooth(spark: SparkSession, sf: str) -> DataFrame:
    return series.moving_average(days(spark, sf), 7).select("at", F.round("smooth", 4).alias("smooth"))


@query(
    "pareto",
    "WITH t AS (SELECT l_partkey AS label, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice) > 0) "
    "SELECT label, round(value, 2) AS value, round(value / sum(value) OVER (), 8) AS share, "
    "round(sum(value) OVER (ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) / sum(value) OVER (), 6) AS cumulative FROM t",
)
def _pareto(spark: SparkSession, sf: str) -> DataFrame:
    made = series.running_share(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice")
    return made.select("label", F.round("value", 2).alias("value"), F.round("share", 8).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query(
    "neighbour_median",
    f"WITH d AS (SELECT *, row_number() OVER (ORDER BY \"at\") AS n FROM ({_DAYS})) "
    "SELECT CAST(a.at AS TIMESTAMP) AS \"at\", round(median(b.y), 4) AS expected FROM d a JOIN d b ON abs(a.n - b.n) <= 3 AND a.n <> b.n GROUP BY 1",
)
def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return series.expected(days(spark, sf), weekly=False).select("at", F.round("expected", 4).alias("expected"))


_WEEKLY = (
    f"WITH d AS (SELECT CAST(\"at\" AS DATE) AS \"at\", y FROM ({_DAYS})), "
    "m AS (SELECT a.at, median(b.y) AS e FROM d a JOIN d b ON a.at <> b.at AND abs(datediff('day', a.at, b.at)) <= 35 AND datediff('day', a.at, b.at) % 7 = 0 GROUP BY 1), "
    "e AS (SELECT d.at, d.y, coalesce(m.e, d.y) AS e, d.y - coalesce(m.e, d.y) AS r FROM d LEFT JOIN m ON d.at = m.at), "
    "s AS (SELECT 1.4826 * median(abs(r - (SELECT median(r) FROM e))) AS s FROM e) "
)


@query("weekday_median", f"{_WEEKLY} SELECT CAST(\"at\" AS TIMESTAMP) AS \"at\", round(e, 4) AS expected FROM e")
def _weekdays(spark: SparkSession, sf: str) -> DataFrame:
    return series.expected(days(spark, sf), weekly=True).select("at", F.round("expected", 4).alias("expected"))


@query("point_scores", f"{_WEEKLY} SELECT CAST(\"at\" AS TIMESTAMP) AS \"at\", round(y, 4) AS y, round(e, 4) AS expected, round(r / s, 6) AS score FROM e, s")
def _scores(spark: SparkSession, sf: str) -> DataFrame:
    made = series.scored(days(spark, sf), weekly=True)
    return made.select("at", F.round("y", 4).alias("y"), F.round("expected", 4).alias("expected"), F.round("score", 6).alias("score"))


#: A day a hundred times as busy as others.
_SPIKE = "CASE WHEN CAST(o_orderdate AS DATE) = DATE '1997-03-15' THEN 100 ELSE 1 END * o_totalprice"


@query(
    "unusual_months",
    f"WITH d AS (SELECT date_trunc('month', o_orderdate) AS \"at\", sum({_SPIKE}) AS y, row_number() OVER (ORDER BY date_trunc('month', o_orderdate)) AS n FROM orders GROUP BY 1), "
    "e AS (SELECT a.at, a.y, median(b.y) AS e, a.y - median(b.y) AS r FROM d a JOIN d b ON abs(a.n - b.n) <= 3 AND a.n <> b.n GROUP BY a.at, a.y), "
    "s AS (SELECT 1.4826 * median(abs(r - (SELECT median(r) FROM e))) AS s FROM e) "
    "SELECT CAST(\"at\" AS TIMESTAMP) AS \"at\", round(y, 2) AS y, round(r / s, 4) AS score FROM e, s WHERE abs(r / s) >= 3.5",
)
def _unusual(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("amount", F.expr(_SPIKE))
    return series.unusual(orders, "o_orderdate", "amount", "month").select("at", F.round("y", 2).alias("y"), F.round("score", 4).alias("score"))


@query(
    "regular_days",
    "WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS \"at\", CAST(count(*) AS DOUBLE) AS y FROM events WHERE event_type = 'signup' AND day(ts) % 4 <> 2 GROUP BY 1), "
    "c AS (SELECT CAST(unnest(generate_series((SELECT min(\"at\") FROM d), (SELECT max(\"at\") FROM d), INTERVAL 1 DAY)) AS DATE) AS \"at\"), "
    "p AS (SELECT c.at, d.y FROM c LEFT JOIN d ON c.at = d.at), "
    "n AS (SELECT \"at\", y, (SELECT max(\"at\") FROM d WHERE d.at <= p.at) AS a, (SELECT min(\"at\") FROM d WHERE d.at >= p.at) AS b FROM p) "
    "SELECT CAST(n.at AS TIMESTAMP) AS \"at\", round(coalesce(n.y, x.y + (z.y - x.y) * datediff('day', a, n.at) / datediff('day', a, b)), 6) AS y, n.y IS NULL AS filled "
    "FROM n JOIN d x ON x.at = a JOIN d z ON z.at = b",
)
def _regular(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "events").where("event_type = 'signup' AND day(ts) % 4 <> 2")
    return series.regular(series.totals(held, "ts", None, "day"), "day").withColumn("y", F.round("y", 6))


def _forecast_sql(key: str, shown: str, final: str = "") -> str:
    """Six months ahead of monthly order totals by ``key``: every setting is run a month at a time, over all months and
    over all but the last six, whose errors are those of the forecast. The orders span more than two years, so the
    pattern is a year."""
    settings = ", ".join(f"({i}, {a}, {b}, {p}, {c})" for i, (a, b, p, c) in enumerate(itertools.product(forecast.ALPHAS, forecast.BETAS, forecast.PHIS, forecast.GAMMAS)))
    before, after = "(PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY k ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""
WITH RECURSIVE m AS (SELECT {key} AS k, date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
f AS (SELECT k, unnest(generate_series(min(d), max(d), INTERVAL 1 MONTH)) AS d FROM m GROUP BY k),
r AS (SELECT f.k, f.d, y, row_number() OVER (PARTITION BY f.k ORDER BY f.d) AS n FROM f LEFT JOIN m ON f.k = m.k AND f.d = m.d),
q AS (SELECT *, last_value(y IGNORE NULLS) OVER {before} AS y0, last_value(CASE WHEN y IS NOT NULL THEN n END IGNORE NULLS) OVER {before} AS n0,
  first_value(y IGNORE NULLS) OVER {after} AS y1, first_value(CASE WHEN y IS NOT NULL THEN n END IGNORE NULLS) OVER {after} AS n1 FROM r),
s AS (SELECT k, list(coalesce(y, y0 + (y1 - y0) * (n - n0) / (n1 - n0)) ORDER BY n) AS ys, count(*) AS n, max(d) AS last FROM q GROUP BY k),
v AS (SELECT k, 0 AS v, ys, n, last FROM s UNION ALL SELECT k, 1, ys[1:n - 6], n - 6, last FROM s),
g(g, a, b, p, c) AS (VALUES {settings}),
z AS (
  SELECT k, v, g, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(p AS DOUBLE) AS p, CAST(c AS DOUBLE) AS c, ys, n, last, CAST(12 AS BIGINT) AS t, list_avg(ys[1:12]) AS level,
    (list_avg(ys[13:24]) - list_avg(ys[1:12])) / 12 AS trend, list_transform(ys[1:12], lambda x: x - list_avg(ys[1:12])) AS season, CAST(0 AS DOUBLE) AS err FROM v, g
  UNION ALL
  SELECT k, v, g, a, b, p, c, ys, n, last, t + 1, made, b * (made - level) + (1 - b) * p * trend,
    list_transform(season, lambda x, i: CASE WHEN i = t % 12 + 1 THEN c * (y - made) + (1 - c) * own ELSE x END), err + (y - drift - own) * (y - drift - own)
  FROM (SELECT *, a * (y - own) + (1 - a) * drift AS made FROM (SELECT *, ys[t + 1] AS y, season[t % 12 + 1] AS own, level + p * trend AS drift FROM z WHERE t < n))),
best AS (SELECT * FROM z WHERE t = n QUALIFY row_number() OVER (PARTITION BY k, v ORDER BY err, g) = 1),
h AS (SELECT *, unnest(range(1, 7)) AS h FROM best),
o AS (SELECT k, v, h, n, last, level + list_sum(list_transform(range(1, h + 1), lambda j: pow(p, j))) * trend + season[(h - 1 + n) % 12 + 1] AS value,
  sqrt(err / (n - 12)) * sqrt(1 + (h - 1) * a * a * (1 + h * b + h * (2 * h - 1) * b * b / 6)) AS dev FROM h),
e AS (SELECT o.k, avg(abs(s.ys[o.n + o.h] - greatest(value, 0))) AS error, avg(abs(s.ys[o.n + o.h])) AS size FROM o JOIN s ON o.k = s.k WHERE v = 1 GROUP BY 1)
{final or f'''SELECT {shown}CAST(last + to_months(CAST(h AS INTEGER)) AS TIMESTAMP) AS "at", round(greatest(value, 0), 2) AS y, round(greatest(value - {forecast.Z80} * dev, 0), 2) AS low,
  round(greatest(value + {forecast.Z80} * dev, 0), 2) AS high, 12 AS cycle, round(error, 2) AS error FROM o JOIN e ON o.k = e.k WHERE v = 0'''}
"""


def cents(made: DataFrame) -> DataFrame:
    return made.withColumns({c: F.round(c, 2) for c in ("y", "low", "high", "error")})


@query("forecast_monthly", _forecast_sql("0", ""))
def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return cents(forecast.forecasts(series.totals(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month"), "month"))


@query("forecast_by_group", _forecast_sql("o_orderpriority", "o.k AS o_orderpriority, "))
def _by_group(spark: SparkSession, sf: str) -> DataFrame:
    each = series.totals(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", ["o_orderpriority"])
    return cents(forecast.forecasts(each, "month", 6, ["o_orderpriority"]))


@query(
    "forecast_total",
    _forecast_sql(
        "o_orderpriority", "",
        f"SELECT o.k AS o_orderpriority, 6 AS horizon, round(sum(greatest(value, 0)), 2) AS total, round(greatest(sum(greatest(value, 0)) - {forecast.Z80} * sqrt(sum(dev * dev)), 0), 2) AS total_low, "
        f"round(sum(greatest(value, 0)) + {forecast.Z80} * sqrt(sum(dev * dev)), 2) AS total_high, round(avg(greatest(value, 0)), 2) AS average, round(any_value(error), 2) AS error, "
        "round(any_value(error / size), 6) AS error_share, CAST(any_value(gaps) AS BIGINT) AS filled FROM o JOIN e ON o.k = e.k "
        "JOIN (SELECT k, count(*) FILTER (y IS NULL) AS gaps FROM r GROUP BY k) w ON w.k = o.k WHERE v = 0 GROUP BY o.k",
    ),
)
def _total(spark: SparkSession, sf: str) -> DataFrame:
    each = series.totals(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", ["o_orderpriority"])
    made = forecast.forecast_totals(each, "month", 6, ["o_orderpriority"])
    return made.withColumns({c: F.round(c, 2) for c in ("total", "total_low", "total_high", "average", "error")}).withColumn("error_share", F.round("error_share", 6))
