"""Descriptive statistics and sufficient statistics of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import significance, stats
from .registry import query, table

_SKEW = "avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5)"


@query(
    "describe",
    "SELECT 'l_quantity' AS column_name, count(*) AS n, round(sum(x), 2) AS total, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS low, "
    "quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS high, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, "
    "(SELECT round(avg(pow(l_quantity - m, 3)) / pow(avg(pow(l_quantity - m, 2)), 1.5), 6) FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)) AS skew, "
    "CAST((SELECT count(*) FROM lineitem, (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem) "
    "WHERE l_quantity < a - 1.5 * (b - a) OR l_quantity > b + 1.5 * (b - a)) AS BIGINT) AS outliers FROM (SELECT l_quantity AS x FROM lineitem) "
    "UNION ALL SELECT 'l_extendedprice', count(*), round(sum(x), 2), round(avg(x), 6), round(stddev_samp(x), 6), min(x), "
    "quantile_cont(x, 0.25), median(x), quantile_cont(x, 0.75), max(x), quantile_cont(x, 0.75) - quantile_cont(x, 0.25), "
    "(SELECT round(avg(pow(l_extendedprice - m, 3)) / pow(avg(pow(l_extendedprice - m, 2)), 1.5), 6) FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)), "
    "CAST((SELECT count(*) FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) "
    "WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) AS BIGINT) FROM (SELECT l_extendedprice AS x FROM lineitem)",
)
def _describe(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).drop("fence_low", "fence_high")
    return made.withColumns({"total": F.round("total", 2), **{c: F.round(c, 6) for c in ("mean", "std", "skew")}, "outliers": F.col("outliers").cast("long")})


@query("skewness", "SELECT round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skew FROM events, (SELECT avg(value) AS m FROM events)")
def _skew(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.round(F.coalesce(F.skewness("value"), F.lit(0.0)), 6).alias("skew"))


@query(
    "histogram",
    "WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, count(*) AS n FROM orders), "
    "t AS (SELECT a, b, (b - a) / least(40, greatest(5, ceil(log2(n) + 1))) AS raw FROM s), "
    "u AS (SELECT a, b, pow(10, floor(log10(raw))) AS mag, raw / pow(10, floor(log10(raw))) AS r FROM t), "
    "v AS (SELECT a, b, mag * CASE WHEN r < 1.5 THEN 1 WHEN r < 3 THEN 2 WHEN r < 7 THEN 5 ELSE 10 END AS step FROM u), "
    "w AS (SELECT *, floor(a / step) * step AS start, CAST(ceil(b / step) - floor(a / step) - 1 AS INT) AS last FROM v), "
    "e AS (SELECT unnest(range(last + 1)) AS bin, step, start FROM w), "
    "c AS (SELECT least(CAST(floor((o_totalprice - start) / step) AS INT), last) AS bin, count(*) AS n FROM orders, w GROUP BY 1) "
    "SELECT CAST(e.bin AS INT) AS bin, round(start + e.bin * step, 10) AS low, round(start + (e.bin + 1) * step, 10) AS high, coalesce(n, 0) AS n FROM e LEFT JOIN c ON e.bin = c.bin",
)
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(table(spark, sf, "orders"), "o_totalprice")


@query(
    "corr_matrix",
    "SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem "
    "UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) FROM lineitem "
    "UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) FROM lineitem",
)
def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 8))


@query(
    "regression",
    "SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, "
    "round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem",
)
def _line(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return made.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 8).alias("r2"))


@query(
    "welch_stats",
    "WITH g AS (SELECT o_orderstatus AS k, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), "
    "p AS (SELECT a.n AS n1, b.n AS n2, a.m - b.m AS diff, a.v / a.n AS s1, b.v / b.n AS s2, a.v AS v1, b.v AS v2 FROM g a, g b WHERE a.k = 'F' AND b.k = 'O') "
    "SELECT n1, n2, round(diff, 6) AS diff, round(diff / sqrt(s1 + s2), 8) AS t, round(pow(s1 + s2, 2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)), 4) AS df, "
    "round(diff / sqrt((v1 + v2) / 2), 8) AS d FROM p",
)
def _welch(spark: SparkSession, sf: str) -> DataFrame:
    w = significance.welch(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "F", "O")
    return spark.createDataFrame(
        [(w.n1, w.n2, round(w.diff, 6), round(w.t, 8), round(w.df, 4), round(w.d, 8))], "n1 long, n2 long, diff double, t double, df double, d double"
    )


@query(
    "anova_stats",
    "WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), "
    "a AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m FROM g), "
    "s AS (SELECT sum(g.n * pow(g.m - a.m, 2)) AS b, sum((g.n - 1) * g.v) AS w, any_value(a.n) AS n, any_value(a.k) AS k FROM g, a) "
    "SELECT round(b / (k - 1) / (w / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2, round(b / (b + w), 8) AS eta2 FROM s",
)
def _anova(spark: SparkSession, sf: str) -> DataFrame:
    a = significance.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return spark.createDataFrame([(round(a.f, 6), a.df1, a.df2, round(a.eta2, 8))], "f double, df1 long, df2 long, eta2 double")


@query(
    "chi_square",
    "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), "
    "r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), l AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c), "
    "e AS (SELECT r.n * l.n / t.n::DOUBLE AS e, coalesce(c.n, 0) AS n, t.n AS total FROM r CROSS JOIN l CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = l.b), "
    "s AS (SELECT sum(pow(n - e, 2) / e) AS x, any_value(total) AS total FROM e) "
    "SELECT round(x, 6) AS chi2, CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM l) - 1) AS BIGINT) AS df, "
    "round(sqrt(x / (total * least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM l) - 1))), 8) AS v FROM s",
)
def _chi(spark: SparkSession, sf: str) -> DataFrame:
    c = significance.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return spark.createDataFrame([(round(c.chi2, 6), c.df, round(c.v, 8))], "chi2 double, df long, v double")


_STEPS = 300
_P_SQL = f"""
WITH RECURSIVE held AS (
  SELECT 'welch ' || o_orderpriority AS test, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m2,
    var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS v2,
    count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS n1, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS n2 FROM orders GROUP BY 1),
welch AS (SELECT test, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS stat, 1.0::DOUBLE AS df1,
  pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df2 FROM held),
corr AS (SELECT 'correlation ' || p_brand AS test, corr(p_size, p_retailprice) AS r, count(*)::DOUBLE AS n FROM part GROUP BY 1 HAVING count(*) > 3),
groups AS (SELECT o_orderpriority AS k, o_orderstatus AS g, count(*)::DOUBLE AS c, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1, 2 HAVING count(*) > 1),
sums AS (SELECT k, sum(c) AS n, count(*)::DOUBLE AS g, sum(c * m * m) - pow(sum(c * m), 2) / sum(c) AS between_, sum((c - 1) * v) AS within_ FROM groups GROUP BY k),
tests AS (
  SELECT test, stat, stat * stat AS f, df1, df2 FROM welch UNION ALL
  SELECT test, r * sqrt((n - 2) / (1 - r * r)), r * r * (n - 2) / (1 - r * r), 1, n - 2 FROM corr UNION ALL
  SELECT 'anova ' || k, between_ / (g - 1) / (within_ / (n - g)), between_ / (g - 1) / (within_ / (n - g)), g - 1, n - g FROM sums),
given AS (SELECT *, df2 / 2 AS a0, df1 / 2 AS b0, df2 / (df2 + df1 * f) AS x0 FROM tests),
turned AS (SELECT *, x0 > (a0 + 1) / (a0 + b0 + 2) AS turn FROM given),
parts AS (SELECT test, stat, turn, CASE WHEN turn THEN b0 ELSE a0 END AS a, CASE WHEN turn THEN a0 ELSE b0 END AS b, CASE WHEN turn THEN 1 - x0 ELSE x0 END AS x FROM turned),
steps AS (
  SELECT test, 0 AS k, a, b, x, 1.0::DOUBLE AS v, 1.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM parts
  UNION ALL
  SELECT test, k + 1, a, b, x, v * (1 + w / c) / (1 + w * d), 1 + w / c, 1 / (1 + w * d) FROM (
    SELECT *, CASE WHEN (k + 1) % 2 = 0 THEN ((k + 1) // 2) * (b - (k + 1) // 2) * x / ((a + 2 * ((k + 1) // 2) - 1) * (a + 2 * ((k + 1) // 2)))
      ELSE -(a + (k + 1) // 2) * (a + b + (k + 1) // 2) * x / ((a + 2 * ((k + 1) // 2)) * (a + 2 * ((k + 1) // 2) + 1)) END AS w FROM steps WHERE k < {_STEPS})),
share AS (SELECT p.test, stat, turn, exp(lgamma(p.a + p.b) - lgamma(p.a) - lgamma(p.b) + p.a * ln(p.x) + p.b * ln(1 - p.x)) / p.a / s.v AS s
  FROM parts p JOIN steps s ON s.test = p.test AND s.k = {_STEPS})
SELECT test, round(stat, 6) AS stat, round(CASE WHEN turn THEN 1 - s ELSE s END, 8) AS p FROM share
"""


@query("p_values_by_group", _P_SQL)
def _p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Three tests within each group of a column, their p-values as expressions."""
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    welch = significance.welch_by(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "F", "O").withColumnRenamed("t", "stat")
    corr = significance.correlation_by(part, "p_brand", "p_size", "p_retailprice").withColumnRenamed("t", "stat")
    anova = significance.anova_by(orders, "o_orderpriority", "o_orderstatus", "o_totalprice").withColumnRenamed("f", "stat")
    named = [d.select(F.concat(F.lit(f"{n} "), "by").alias("test"), "stat", "p") for n, d in (("welch", welch), ("correlation", corr), ("anova", anova))]
    return named[0].unionByName(named[1]).unionByName(named[2]).select("test", F.round("stat", 6).alias("stat"), F.round("p", 8).alias("p"))
