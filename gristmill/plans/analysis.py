"""Changes, comparisons, contributors, cohorts, funnels, patterns, delays, models, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analyses, charts, insights, texts
from ..operators.sorting import with_row_numbers
from .registry import query, table


@query(
    "explain_change",
    "WITH r AS (SELECT *, strftime(o_orderdate, '%Y') = '1998' AS late FROM orders WHERE year(o_orderdate) IN (1997, 1998)), "
    "l AS (SELECT 'o_orderstatus' AS \"by\", o_orderstatus AS label, late, o_totalprice AS v FROM r UNION ALL SELECT 'o_orderpriority', o_orderpriority, late, o_totalprice FROM r), "
    "p AS (SELECT \"by\", label, coalesce(sum(v) FILTER (NOT late), 0) AS before, coalesce(sum(v) FILTER (late), 0) AS after FROM l GROUP BY 1, 2), "
    "k AS (SELECT *, abs(after - before) AS c, row_number() OVER (PARTITION BY \"by\" ORDER BY abs(after - before) DESC) AS n FROM p), "
    "s AS (SELECT \"by\", sum(c) FILTER (n <= 3) / sum(c) AS score FROM k GROUP BY 1) "
    "SELECT \"by\", label, round(before, 2) AS before, round(after, 2) AS after, round(after - before, 2) AS change, round(score, 6) AS score FROM k JOIN s USING (\"by\")",
)
def _change(spark: SparkSession, sf: str) -> DataFrame:
    made = analyses.explain_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", periods=("1997", "1998"), unit="year")
    return made.select("by", "label", *[F.round(c, 2).alias(c) for c in ("before", "after", "change")], F.round("score", 6).alias("score"))


@query(
    "compare_groups",
    "WITH g AS (SELECT l_returnflag AS k, x.* FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount)) AS x(c, v) WHERE l_returnflag IN ('A', 'N')), "
    "m AS (SELECT c, k, count(v) AS n, avg(v) AS m, var_samp(v) AS s FROM g GROUP BY 1, 2) "
    "SELECT a.c AS column_name, round(a.m, 6) AS mean1, round(b.m, 6) AS mean2, round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) AS d, "
    "round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 6) AS t FROM m a JOIN m b USING (c) WHERE a.k = 'A' AND b.k = 'N'",
)
def _compare(spark: SparkSession, sf: str) -> DataFrame:
    found = analyses.group_differences(table(spark, sf, "lineitem"), "l_returnflag", "A", "N", ["l_quantity", "l_extendedprice", "l_discount"])
    rows = [(x.column, round(x.mean1, 6), round(x.mean2, 6), round(x.d, 6), round(x.test.t, 6)) for x in found]
    return spark.createDataFrame(rows, "column_name string, mean1 double, mean2 double, d double, t double")


@query("simpson", "SELECT 'level' AS \"by\"")
def _simpson(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in two kinds: large ones are mostly kind a and dear, but within a size kind a is the cheaper one."""
    part = table(spark, sf, "part").select(
        F.when((F.col("p_size") > 25) == (F.col("p_partkey") % 5 != 0), "a").otherwise("b").alias("kind"),
        F.when(F.col("p_size") > 25, "large").otherwise("small").alias("level"),
        F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("half"),
        F.when(F.col("p_size") > 25, 100.0).otherwise(10.0).alias("base"),
    )
    part = part.withColumn("price", F.col("base") - F.when(F.col("kind") == "a", 3.0).otherwise(0.0))
    found = analyses.reversals(part, "kind", "a", "b", "price", ["level", "half"])
    return spark.createDataFrame([(c,) for c in found], "by string")


@query(
    "cohort_returns",
    "WITH s AS (SELECT DISTINCT o_custkey AS id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders), "
    "f AS (SELECT id, m, min(m) OVER (PARTITION BY id) AS f FROM s), z AS (SELECT f, count(DISTINCT id) AS size FROM f GROUP BY 1), "
    "k AS (SELECT f, size, unnest(range(1, 7)) AS later FROM z), b AS (SELECT f, m - f AS later, count(*) AS back FROM f GROUP BY 1, 2) "
    "SELECT printf('%04d-%02d', CAST(k.f // 12 AS INT), CAST(k.f % 12 + 1 AS INT)) AS cohort, size, CAST(k.later AS INT) AS later, "
    "CASE WHEN k.f + k.later <= (SELECT max(m) FROM s) THEN coalesce(back, 0) END AS back, "
    "round(CASE WHEN k.f + k.later <= (SELECT max(m) FROM s) THEN coalesce(back, 0) END / size::DOUBLE, 8) AS rate FROM k LEFT JOIN b ON k.f = b.f AND k.later = b.later",
)
def _cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.cohorts(table(spark, sf, "orders"), "o_custkey", "o_orderdate").withColumn("rate", F.round("rate", 8))


_USERS = "SELECT user_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1"


def users(spark: SparkSession, sf: str) -> DataFrame:
    did = lambda kind: F.bool_or(F.col("event_type") == kind)
    return table(spark, sf, "events").groupBy("user_id").agg(did("view").alias("viewed"), did("click").alias("clicked"), did("purchase").alias("bought"))


@query(
    "funnel",
    f"WITH u AS ({_USERS}), n AS (SELECT count(*) AS a, count(*) FILTER (viewed) AS b, count(*) FILTER (viewed AND clicked) AS c, count(*) FILTER (viewed AND clicked AND bought) AS d FROM u) "
    "SELECT 0 AS step, 'All rows' AS name, a AS n, 1.0::DOUBLE AS of_start, 1.0::DOUBLE AS of_previous FROM n "
    "UNION ALL SELECT 1, 'viewed', b, round(b / a, 8), round(b / a, 8) FROM n UNION ALL SELECT 2, 'clicked', c, round(c / a, 8), round(c / b, 8) FROM n "
    "UNION ALL SELECT 3, 'bought', d, round(d / a, 8), round(d / c, 8) FROM n",
)
def _funnel(spark: SparkSession, sf: str) -> DataFrame:
    made = analyses.funnel(users(spark, sf), ["viewed", "clicked", "bought"])
    return made.withColumns({c: F.round(c, 8) for c in ("of_start", "of_previous")})


for _unit, _slot in (("weekday", 'isodow("at") - 1'), ("month", 'month("at")')):

    def _pattern(unit: str):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return analyses.pattern(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", unit).select(F.col("slot").cast("long").alias("slot"), "n", F.round("effect", 8).alias("effect"))

        return run

    query(
        f"pattern_{_unit}",
        "WITH d AS (SELECT date_trunc('day', o_orderdate) AS \"at\", sum(o_totalprice) AS y FROM orders GROUP BY 1) "
        f"SELECT CAST({_slot} AS BIGINT) AS slot, count(*) AS n, round(avg(y) / (SELECT avg(y) FROM d) - 1, 8) AS effect FROM d GROUP BY 1",
    )(_pattern(_unit))


@query(
    "trend",
    "WITH d AS (SELECT date_trunc('day', o_orderdate) AS \"at\", sum(o_totalprice) AS y FROM orders GROUP BY 1), "
    "m AS (SELECT date_trunc('month', \"at\") AS k, avg(y) AS y, row_number() OVER (ORDER BY date_trunc('month', \"at\")) - 1 AS x FROM d GROUP BY 1) "
    "SELECT 'month' AS step, count(*) AS steps, round(regr_slope(y, x), 4) AS slope, round(regr_slope(y, x) / avg(y), 8) AS share FROM m",
)
def _trend(spark: SparkSession, sf: str) -> DataFrame:
    made = analyses.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return made.select("step", "steps", F.round("slope", 4).alias("slope"), F.round("share", 8).alias("share"))


@query(
    "delayed_effect",
    "WITH k AS (SELECT CAST(ts AS DATE) AS k, avg(value) AS c, avg(user_id) AS e FROM events GROUP BY 1), l AS (SELECT unnest(range(8)) AS lag) "
    "SELECT CAST(lag AS INT) AS lag, count(*) AS n, round(corr(b.c, a.e), 6) AS r FROM l CROSS JOIN k a JOIN k b ON b.k = a.k - CAST(lag AS INT) GROUP BY 1",
)
def _delayed(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.delayed(table(spark, sf, "events"), "ts", "value", "user_id").withColumn("r", F.round("r", 6))


@query("what_if", "SELECT o_orderkey, 5.0::DOUBLE + 2 * (o_orderkey % 7) + CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS predicted FROM orders")
def _what_if(spark: SparkSession, sf: str) -> DataFrame:
    """A target that is a sum of two inputs is predicted exactly."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 7).cast("double").alias("x"))
    orders = orders.withColumn("y", 5 + 2 * F.col("x") + F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 1).otherwise(0))
    model = analyses.what_if(orders, "y", ["x", "o_orderstatus"])
    return orders.select("o_orderkey", F.round(model.column(orders), 2).alias("predicted"))


@query(
    "natural_groups",
    "SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN 0 WHEN p_partkey % 6 < 5 THEN 100 ELSE 200 END + p_size / 10 AS x, "
    "CASE WHEN p_partkey % 6 < 3 THEN 300 WHEN p_partkey % 6 < 5 THEN 0 ELSE 150 END + p_retailprice / 1000 AS y, "
    "CASE WHEN p_partkey % 6 < 3 THEN 1 WHEN p_partkey % 6 < 5 THEN 2 ELSE 3 END AS segment FROM part",
)
def _groups(spark: SparkSession, sf: str) -> DataFrame:
    """Three clouds of different sizes that any good clustering finds."""
    at = F.col("p_partkey") % 6
    cloud = lambda a, b, c: F.when(at < 3, a).when(at < 5, b).otherwise(c)
    held = table(spark, sf, "part").select("p_partkey", (cloud(0, 100, 200) + F.col("p_size") / 10).alias("x"), (cloud(300, 0, 150) + F.col("p_retailprice") / 1000).alias("y"))
    return analyses.natural_groups(held, ["x", "y"], order=["p_partkey"])[0]


_TALK = (
    "SELECT * FROM (VALUES ('The wait was long but the staff were friendly'), ('Friendly staff, great coffee'), ('Long wait again, not good'), "
    "('Coffee was cold and the wait was terrible'), ('Friendly staff and quick service'), ('I love the coffee here'), ('Prices are not bad'), ('Friendly staff!')) AS t(comment)"
)


#: All turns of all conversations, and the sentences above, as their texts hold few words of feeling.
_COMMENTS = f"SELECT text AS comment FROM conversations UNION ALL {_TALK}"
_SPOKEN = (
    "c AS (SELECT row_number() OVER () AS r, regexp_extract_all(replace(lower(comment), '’', ''''), '[\\p{L}\\p{N}'']+') AS w "
    f"FROM ({_COMMENTS}) WHERE comment IS NOT NULL AND trim(comment) <> '')"
)


def _listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_STEM = "CASE WHEN ends_with(x, 'ies') THEN regexp_replace(x, 'ies$', 'y') ELSE regexp_replace(x, '(ingly|edly|ing|ed|es|s|ly)$', '') END"
_TONE_SQL = (
    f"WITH {_SPOKEN}, x AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM c), "
    f"s AS (SELECT r, sum(CASE WHEN w[i] IN {_listed(texts.POSITIVE)} THEN 1 WHEN w[i] IN {_listed(texts.NEGATIVE)} THEN -1 ELSE 0 END * "
    f"CASE WHEN i > 1 AND w[i - 1] IN {_listed(texts.NEGATIONS)} OR i > 2 AND w[i - 2] IN {_listed(texts.NEGATIONS)} THEN -1 ELSE 1 END) AS v FROM x GROUP BY r) "
    "SELECT CAST(sign(coalesce(v, 0)) AS INTEGER) AS tone, count(*) AS n FROM c LEFT JOIN s USING (r) GROUP BY 1"
)
_THEMES_SQL = (
    f"WITH {_SPOKEN}, k AS (SELECT r, list_filter(w, lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM c), "
    "u AS (SELECT r, w, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM k), "
    f"cut AS (SELECT r, x, {_STEM} AS y FROM u WHERE length(x) > 2 AND x NOT IN {_listed(texts.STOP)}), "
    "undoubled AS (SELECT r, x, CASE WHEN length(y) > 1 AND right(y, 1) = left(right(y, 2), 1) THEN left(y, length(y) - 1) ELSE y END AS y FROM cut), "
    "stemmed AS (SELECT DISTINCT r, x AS form, CASE WHEN length(x) <= 4 THEN x WHEN regexp_replace(y, 'e$', '') = '' THEN x ELSE regexp_replace(y, 'e$', '') END AS term FROM undoubled), "
    "stems AS (SELECT term, count(DISTINCT r) AS n FROM stemmed GROUP BY 1), "
    "forms AS (SELECT term, form, count(*) AS k FROM stemmed GROUP BY 1, 2), "
    "shown AS (SELECT term, form AS shown FROM forms QUALIFY row_number() OVER (PARTITION BY term ORDER BY k DESC, form DESC) = 1), "
    "pairs AS (SELECT DISTINCT r, w[i] || ' ' || w[i + 1] AS term FROM u WHERE i < len(w) AND length(w[i]) > 2 AND length(w[i + 1]) > 2 "
    f"AND w[i] NOT IN {_listed(texts.STOP)} AND w[i + 1] NOT IN {_listed(texts.STOP)}), "
    "found AS (SELECT shown, false AS phrase, n FROM stems JOIN shown USING (term) UNION ALL SELECT term, true, count(*) FROM pairs GROUP BY 1), "
    "enough AS (SELECT * FROM found WHERE n >= CASE WHEN (SELECT count(*) FROM c) >= 20 THEN 3 ELSE 2 END), "
    "best AS (SELECT x, max(n) AS m FROM (SELECT unnest(string_split(shown, ' ')) AS x, n FROM enough WHERE phrase) GROUP BY 1) "
    "SELECT shown AS theme, phrase, CAST(n AS INTEGER) AS n FROM enough LEFT JOIN best ON shown = x AND NOT phrase "
    f"WHERE phrase OR coalesce(m, 0) < 0.8 * n AND shown NOT IN {_listed(texts.FEELING_ONLY)} ORDER BY n DESC, phrase DESC, shown LIMIT 15"
)


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("text").alias("comment")).unionByName(spark.sql(_TALK))


@query("text_tone", _TONE_SQL)
def _tone(spark: SparkSession, sf: str) -> DataFrame:
    return texts.tones(comments(spark, sf), "comment")


@query("text_themes", _THEMES_SQL)
def _themes(spark: SparkSession, sf: str) -> DataFrame:
    return texts.themes(comments(spark, sf), "comment").select("theme", "phrase", F.col("n").cast("int").alias("n"))


@query(
    "word_counts",
    "WITH w AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+') AS w FROM conversations) "
    "SELECT x AS word, count(*) AS n FROM (SELECT DISTINCT r, unnest(w) AS x FROM w) GROUP BY 1",
)
def _words(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "conversations").select(F.explode(F.array_distinct(texts.words(F.col("text")))).alias("word"))
    return held.groupBy("word").agg(F.count("*").alias("n"))


_MESSY = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || lower(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance, 'x' AS same FROM customer"


def messy(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql(_MESSY)


@query(
    "spelling_variants",
    f"WITH c AS (SELECT segment AS s, count(*) AS n FROM ({_MESSY}) GROUP BY 1) SELECT s AS variant, upper(trim(s)) AS wanted, n FROM c WHERE s <> upper(trim(s))",
)
def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return insights.spelling_variants(messy(spark, sf), "segment")


@query(
    "health_issues",
    f"SELECT 'variants' AS kind, 'segment' AS column_name, count(*) AS n FROM ({_MESSY}) WHERE segment <> upper(trim(segment)) "
    f"UNION ALL SELECT 'missing', 'balance', count(*) FROM ({_MESSY}) WHERE balance IS NULL UNION ALL SELECT 'constant', 'same', count(*) FROM ({_MESSY})",
)
def _health(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(i.kind, i.column, i.rows) for i in insights.health(messy(spark, sf))], "kind string, column_name string, n long")


@query(
    "key_drivers",
    "WITH g AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), "
    "s AS (SELECT sum(n * pow(m - (SELECT avg(l_extendedprice) FROM lineitem), 2)) AS b, sum((n - 1) * v) AS w FROM g) "
    "SELECT 'l_quantity' AS column_name, round(pow(corr(l_quantity, l_extendedprice), 2), 8) AS strength FROM lineitem "
    "UNION ALL SELECT 'l_discount', round(pow(corr(l_discount, l_extendedprice), 2), 8) FROM lineitem UNION ALL SELECT 'l_returnflag', round(b / (b + w), 8) FROM s",
)
def _drivers(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    return spark.createDataFrame([(d.column, round(d.strength, 8)) for d in insights.drivers(held, "l_extendedprice")], "column_name string, strength double")


_SEEN = (
    "SELECT event_id, ts, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, 2 * value + user_id % 3 AS twice, "
    "CASE WHEN event_type = 'view' THEN value + 500 ELSE value % 50 END AS apart, CASE WHEN event_id % 10 = 0 THEN 'rare' ELSE 'common' END AS usual, 'x' AS same FROM events"
)


def _shape(c: str) -> str:
    """SQL of the skewness and of the outliers of a column."""
    return (
        f"SELECT 'skew' AS kind, '{c}' AS columns, skew AS value FROM (SELECT avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5) AS skew FROM t, (SELECT avg({c}) AS m FROM t)) WHERE abs(skew) >= 1 "
        f"UNION ALL SELECT * FROM (SELECT 'outliers', '{c}', count(*) FILTER ({c} NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) / count({c}) AS share "
        f"FROM t, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM t)) WHERE share > 0 AND share <= 0.1"
    )


_FACTS_SQL = (
    f"WITH t AS ({_SEEN}), r AS (SELECT unnest(['value, twice', 'value, apart', 'twice, apart', 'event_id, value', 'event_id, twice', 'event_id, apart']) AS columns, "
    "unnest([corr(value, twice), corr(value, apart), corr(twice, apart), corr(event_id, value), corr(event_id, twice), corr(event_id, apart)]) AS value FROM t), "
    f"s AS ({' UNION ALL '.join(map(_shape, ('value', 'twice', 'apart')))}), "
    "g AS (SELECT 'event_type' AS label, event_type AS k, avg(value) AS m1, avg(twice) AS m2, avg(apart) AS m3, avg(event_id) AS m4 FROM t GROUP BY 2 UNION ALL SELECT 'usual', usual, avg(value), avg(twice), avg(apart), avg(event_id) FROM t GROUP BY 2), "
    "d AS (SELECT label, unnest(['value', 'twice', 'apart', 'event_id']) AS c, unnest([max(m1) - min(m1), max(m2) - min(m2), max(m3) - min(m3), max(m4) - min(m4)]) / unnest((SELECT [stddev_samp(value), stddev_samp(twice), stddev_samp(apart), stddev_samp(event_id)] FROM t)) AS gap FROM g GROUP BY label) "
    "SELECT kind, columns, round(value, 6) AS value FROM (SELECT * FROM (SELECT 'correlation' AS kind, columns, value FROM r WHERE abs(value) >= 0.4 ORDER BY abs(value) DESC LIMIT 3) "
    "UNION ALL SELECT * FROM s WHERE kind = 'skew' UNION ALL SELECT * FROM (SELECT * FROM s WHERE kind = 'outliers' ORDER BY value DESC LIMIT 2) "
    "UNION ALL SELECT 'constant', 'same', 1 UNION ALL SELECT 'dominant', 'usual', avg(CAST(usual = 'common' AS INTEGER)) FROM t "
    "UNION ALL SELECT * FROM (SELECT 'difference', c || ', ' || label, gap FROM d WHERE gap >= 0.5 ORDER BY gap DESC LIMIT 1) "
    "UNION ALL SELECT 'missing', 'value', avg(CAST(value IS NULL AS INTEGER)) FROM t UNION ALL SELECT 'span', 'ts', datediff('day', min(ts), max(ts)) FROM t UNION ALL SELECT 'id', 'event_id', 1)"
)


@query("facts", _FACTS_SQL)
def _facts(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "events").createOrReplaceTempView("events")
    found = insights.facts(spark.sql(_SEEN))
    return spark.createDataFrame([(f.kind, ", ".join(f.columns), round(float(f.value), 6)) for f in found], "kind string, columns string, value double")


@query("chart_line", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS x, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1")
def _line(spark: SparkSession, sf: str) -> DataFrame:
    return charts.line(table(spark, sf, "orders"), "o_orderdate", "o_totalprice").withColumn("y", F.round("y", 4))


@query(
    "chart_line_groups",
    "WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) LIMIT 6) "
    "SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS colour, p_size AS x, CAST(max(p_retailprice) AS DOUBLE) AS y FROM part GROUP BY 1, 2",
)
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return charts.line(table(spark, sf, "part"), "p_size", "p_retailprice", "max", "p_brand")


@query(
    "chart_bars",
    "SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value, row_number() OVER (ORDER BY sum(o_totalprice) DESC) AS rank FROM orders GROUP BY 1",
)
def _bars(spark: SparkSession, sf: str) -> DataFrame:
    made = charts.bars(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum")
    return made.select("label", F.round("value", 2).alias("value"), F.col("rank").cast("long").alias("rank"))


@query("chart_stacked", "SELECT strftime(o_orderdate, '%Y-%m') AS label, o_orderpriority AS colour, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
def _stacked(spark: SparkSession, sf: str) -> DataFrame:
    return charts.stacked(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", "o_totalprice").withColumn("value", F.round("value", 2))


@query(
    "chart_boxes",
    "WITH q AS (SELECT o_orderpriority AS label, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3, avg(o_totalprice) AS mean FROM orders GROUP BY 1) "
    "SELECT label, n, min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, "
    "max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, round(mean, 4) AS mean, "
    "count(*) FILTER (o_totalprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM q JOIN orders ON label = o_orderpriority GROUP BY label, n, q1, median, q3, mean",
)
def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return charts.boxes(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "mean")})


@query(
    "chart_calendar",
    "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1), m AS (SELECT max(day) AS b FROM d), "
    "c AS (SELECT CAST(unnest(generate_series(b - 370, b, INTERVAL 1 DAY)) AS DATE) AS day FROM m) SELECT c.day, round(value, 2) AS value FROM c LEFT JOIN d ON c.day = d.day",
)
def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    return charts.calendar(table(spark, sf, "orders"), "o_orderdate", "o_totalprice").withColumn("value", F.round("value", 2))


@query(
    "chart_points",
    "WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), n AS (SELECT count(*) AS n FROM orders) "
    "SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM o, n WHERE n <= 5000 OR r IN (SELECT CAST(floor(k * n / 5000) AS BIGINT) FROM (SELECT unnest(range(5000)) AS k), n)",
)
def _points(spark: SparkSession, sf: str) -> DataFrame:
    return charts.points(with_row_numbers(table(spark, sf, "orders"), "o_orderkey"), "o_custkey", "o_totalprice")
