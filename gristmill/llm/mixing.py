"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time 0..1, given by its mean weight and a slope. The schedule's
integral is the source's share; its running integral is the cumulative token demand. Documents of a source are laid
out in a fixed pseudo-random order, copy after copy, and the demand is inverted at the word where each copy starts:
that is its training position. Copies that start beyond the source's target get none. A range sort by position is the
curriculum.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its own, last in order; repeated rows
and rows of null id are rows of their own, of which those of null id are dealt by their place in the table (by their text in
``curriculum``, where rows of null id and equal text of a source share a task); an empty table gives no rows; other columns may have any type and name, as
``curriculum`` carries whole rows in one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ..operators.sorting import ROW, with_row_numbers
from .common import bucket_of, dealt_by, fresh, n_words, prefix_sums, saved

#: Copies of a document at most, and so a target's limit in sizes of its source.
MAX_REPEATS = 3
#: Mean weights, repeating over the sources in order.
WEIGHTS = (1, 2, 3)
#: Relative slope of the schedule of each weight: a source of weight 3 is rare at first and common at the end.
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, source: str, size: str) -> DataFrame:
    """One row per source: mix_source, mix_source_size, mix_target, mix_slope.

    The share of all words goes by weight; what exceeds ``MAX_REPEATS`` times a source is dealt to the others by weight
    until none is above. Sources in ascending order of limit/weight are limited from the front, so running sums give the
    level at once. One row per source is summed in one task; the number of sources is the number of corpora, not of
    documents.
    """
    per = sizes.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).alias("mix_source_size"))
    rank = F.row_number().over(W.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    k = rank % len(WEIGHTS)
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    ranked = per.select("*", rank.alias("_rank"), pick(WEIGHTS).alias("_w"), pick(SLOPES).alias("mix_slope"))
    cap = (F.col("mix_source_size") * MAX_REPEATS).cast("double")
    order = W.orderBy((cap / F.col("_w")), "_rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("mix_source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = ranked.select("*", level.alias("_level"), cap.alias("_cap"))
    free = F.col("_level") <= F.col("_cap") / F.col("_w")
    common = F.max(F.when(free, F.col("_level"))).over(everything)  # levels fall after the first free source
    target = F.when(free, F.least(common * F.col("_w"), F.col("_cap"))).otherwise(F.col("_cap"))
    return levels.select("mix_source", "mix_source_size", target.alias("mix_target"), "mix_slope")


def invert_demand(share: Column, slope: Column) -> Column:
    """Time at which a schedule of weight 1 + slope*(2t - 1) has asked for ``share`` of its tokens."""
    rest = F.lit(1.0) - slope
    return F.lit(2.0) * share / (rest + F.sqrt(rest * rest + F.lit(4.0) * slope * share))


def mix(sized: DataFrame, source: str, size: str, key: str, row: str) -> DataFrame:
    """``sized`` with mix_source_size, mix_target, mix_slope, mix_start (words of the source before this row) and
    mix_taken (words the mix takes of it, repeats counted: whole passes over the source, then a part of one).

    Rows lie in the order of hashes of ``key``; those of null key in that of hashes of ``row``, so that they are dealt too.
    """
    digest = dealt_by(F.col(key).cast("string"), F.col(row))
    slim = sized.select(source, size)
    order = [digest, F.col(key).asc_nulls_first(), F.col(size)]
    laid = prefix_sums(sized, [source], order, bucket_of(digest, slim.count()), {"mix_start": size})
    targets = source_targets(slim, source, size)
    joined = laid.join(targets, F.col(source).eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    whole = F.when(
        F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))
    ).otherwise(F.lit(0))
    rest = F.floor(F.col("mix_target") - whole * F.col("mix_source_size") + 0.5)
    part = F.greatest(F.lit(0), F.least(F.col(size), rest - F.col("mix_start")))
    return joined.withColumn("mix_taken", (whole * F.col(size) + part).cast("long"))


def scheduled(mixed: DataFrame, size: str) -> DataFrame:
    """The rows of ``mix`` with mix_positions: the training position (0..1) of each copy that the mix takes.

    Copy k of a row starts after mix_start words and k whole passes over its source; the time at which the source's
    cumulative demand reaches that share of its target is the copy's position.
    """
    copies = F.when(F.col(size) > 0, F.ceil(F.col("mix_taken") / F.col(size))).otherwise(F.lit(0)).cast("int")
    at = lambda k: (F.col("mix_start") + k * F.col("mix_source_size")) / F.col("mix_target")
    each = F.transform(F.sequence(F.lit(0), copies - 1), lambda k: invert_demand(F.least(at(k), F.lit(1.0)), F.col("mix_slope")))
    return mixed.withColumn("mix_positions", F.when(copies > 0, each).otherwise(F.array().cast("array<double>")))


def curriculum(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mixed corpus in training order: a row per copy, all columns of ``docs`` and mix_position in 0..1 (mix_position_1
    if there is such a column).

    A copy that the target ends within is kept whole. Rows without words ask for no tokens and stay out.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, "source", "doc_id", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mix_row"))
    planned = scheduled(mix(sized, "source", "size", "doc_id", "mix_row"), "size")
    placed = planned.select("row", "source", "doc_id", F.posexplode("mix_positions").alias("copy", "position"))
    by = [F.col(c) for c in ("position", "source", "doc_id", "copy")]
    dealt = placed.repartitionByRange(partitions, *by) if partitions else placed.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by).select("row.*", F.col("position").alias(fresh(docs, "mix_position")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: what the mix takes of it, its copies, the positions of the first and last one, and place, the
    number of the document in a range sort by the first position (from 0; null if the mix takes nothing)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("mix_row")))
    planned = scheduled(mix(sized, "source", "size", "doc_id", "mix_row"), "size")
    copies = F.size("mix_positions").cast("long")
    first, last = F.get("mix_positions", F.lit(0)), F.get("mix_positions", F.size("mix_positions") - 1)
    slim = planned.select(
        "doc_id", "source", "size", "mix_start", "mix_source_size", "mix_target", "mix_taken", copies.alias("copies"),
        first.alias("first_position"), last.alias("last_position"), F.coalesce(first, F.lit(2.0)).alias("by"),
    )
    return with_row_numbers(slim, "by", "source", "doc_id", "mix_start").select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        "copies",
        F.round("first_position", 9).alias("first_position"),
        F.round("last_position", 9).alias("last_position"),
        F.when(F.col("copies") > 0, F.col(ROW)).cast("long").alias("place"),
    )


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM per),
weighted AS (
  SELECT *, 1 + rk % 3 AS w, CAST((rk % 3 - 1) * 0.5 AS DOUBLE) AS slope, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, slope, CASE WHEN level <= cap / w
    THEN least(max(CASE WHEN level <= cap / w THEN level END) OVER () * w, cap) ELSE cap END AS target
  FROM levels),
laid AS (
  SELECT s.*, t.source_size, t.target, t.slope, CAST(coalesce(sum(size) OVER (PARTITION BY s.source
      ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - start)) AS BIGINT) AS taken
  FROM laid),
copied AS (SELECT *, CASE WHEN size > 0 THEN CAST(ceil(CAST(taken AS DOUBLE) / size) AS BIGINT) ELSE 0 END AS copies FROM taking),
shares AS (
  SELECT *, CASE WHEN copies > 0 THEN least(start / target, 1.0::DOUBLE) END AS s0,
    CASE WHEN copies > 0 THEN least((start + (copies - 1) * source_size) / target, 1.0::DOUBLE) END AS s1 FROM copied),
placed AS (
  SELECT *, 2.0::DOUBLE * s0 / ((1.0 - slope) + sqrt((1.0 - slope) * (1.0 - slope) + 4.0::DOUBLE * slope * s0)) AS p0,
    2.0::DOUBLE * s1 / ((1.0 - slope) + sqrt((1.0 - slope) * (1.0 - slope) + 4.0::DOUBLE * slope * s1)) AS p1 FROM shares)
SELECT doc_id, size, source_size, target, taken, copies, round(p0, 9) AS first_position, round(p1, 9) AS last_position,
  CASE WHEN copies > 0 THEN row_number() OVER (ORDER BY coalesce(p0, 2.0), source NULLS FIRST, doc_id NULLS FIRST, start NULLS FIRST) - 1 END AS place
FROM placed
"""
