"""A Merkle manifest of a dataset: one digest for the whole, one for each group, and a proof for each row.

A leaf is the digest of a row's columns. Leaves of a group are numbered in the order of a key; every ``FANOUT`` consecutive nodes
are hashed into a parent, level by level, until one is left, the group's subroot. The subroots, in the order of their groups, are
the leaves of one more tree whose top is the root. Each level is a DataFrame written to the shared folder: a grouping by
the floor-divided number collects the at most ``FANOUT`` children of a parent. Siblings then come down again, one join a level:
what lies left and right of a node, then of its parent, up to the root. A row's proof is that list; folding a leaf
through it gives the root again, if the row is what it was.

Numbers are dense within a group although no task holds a group: rows are dealt by range and only the sizes of the ranges
are summed. The list of a node is shared by all rows below it and is copied to them only where it is hashed.

Edge cases: null fields are hashed as such, so null and empty differ; a null group is a group of its own and comes first, null
keys come first in their group; rows of equal key follow each other by their leaf, and equal rows are leaves of their own; a text
of any length is hashed whole; a group of one row has its leaf as subroot; an empty table has no rows and no root; columns
of any other name and type are carried in one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ..operators.sorting import ROW, in_ranges, numbered
from .common import fresh, saved
from .runs import CRC32, crc32_sql

FANOUT = 16
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def group_key(c: Column) -> Column:
    """A group as a text whose order is that of the groups, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def indexed(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (with ``grp``) with ``n``, the number of its group's leaves, and ``idx``, its own in ``order`` from 0."""
    by = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = in_ranges(leaves, by)
    sizes = ranged.groupBy("grp", "_part").agg(F.count("*").alias("_size"))
    own = W.partitionBy("grp")
    before = F.coalesce(F.sum("_size").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("grp", "_part", before.alias("_start"), F.sum("_size").over(own).alias("n"))
    local = ranged.withColumn("_n", F.row_number().over(W.partitionBy("grp", "_part").orderBy(*by[1:])))
    return local.join(starts, ["grp", "_part"]).withColumn("idx", F.col("_start") + F.col("_n") - 1).drop("_part", "_n", "_start")


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes`` (grp, n, idx, digest), from the lowest: a row per parent with grp, n (nodes of its
    group below), idx (its own number), children (their digests, in order) and digest. Groups of one node have no parent."""
    made, level = [], nodes.select("grp", "n", "idx", "digest")
    width = level.agg(F.max("n")).first()[0] or 0
    while width > 1:
        parents = level.where("n > 1").groupBy("grp", "n", F.floor(F.col("idx") / FANOUT).alias("idx"))
        run = F.array_sort(F.collect_list(F.struct(F.col("idx"), F.col("digest"))))
        above = parents.agg(run.alias("run")).select("grp", "n", "idx", F.transform("run", lambda x: x.digest).alias("children"))
        made.append(saved(above.withColumn("digest", digest(F.array_join("children", "")))))
        level = made[-1].select("grp", F.ceil(F.col("n") / FANOUT).alias("n"), "idx", "digest")
        width = -(-width // FANOUT)
    return made


def is_top() -> Column:
    """Whether a parent is the only one of its group on its level."""
    return F.col("n") <= FANOUT


def tops_of(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """What is left of each group: grp and digest."""
    found = nodes.where("n = 1").select("grp", "digest")
    for level in levels:
        found = found.unionByName(level.where(is_top()).select("grp", "digest"))
    return found


def step(children: Column, at: Column) -> Column:
    """What lies left and right of child ``at`` (from 0) of a parent."""
    side = lambda first, length: F.array_join(F.slice(children, first, length), "")
    return F.struct(side(F.lit(1), at.cast("int")).alias("left"), side((at + 2).cast("int"), F.lit(FANOUT)).alias("right"))


def with_steps(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with steps, the siblings of each from its own level to its group's top and on, and the other columns of
    ``tops`` (grp, above, ...), whose above is what follows a group's top."""
    carried = [c for c in tops.columns if c not in ("grp", "above")]
    own = lambda at: F.concat(F.array(step(F.col("children"), at)), F.col("above"))
    below = None
    for level in reversed(levels):
        found = level.where(is_top()).join(tops, "grp")
        if below is not None:
            inner = level.where(~is_top()).join(below, ["grp", "idx"])
            found = found.unionByName(inner.select(found.columns))
        found = found.select("grp", F.col("idx").alias("run"), "children", "above", *carried)
        at = found.select("grp", "run", "above", *carried, "children", F.posexplode("children").alias("at", "_child"))
        below = at.select("grp", (F.col("run") * FANOUT + F.col("at")).alias("idx"), own(F.col("at")).alias("above"), *carried)
        last = found
    alone = nodes.where("n = 1").join(tops, "grp").withColumnRenamed("above", "steps").select(*nodes.columns, "steps", *carried)
    if below is None:
        return alone
    keyed = nodes.where("n > 1").withColumn("run", F.floor(F.col("idx") / FANOUT))
    many = keyed.join(last, ["grp", "run"]).withColumn("steps", own(F.col("idx") % FANOUT))
    return alone.unionByName(many.select(*nodes.columns, "steps", *carried))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings on its way."""
    return F.aggregate(steps, leaf, lambda d, s: digest(s.left, d, s.right))


def proof(steps: Column) -> Column:
    """The digest of all siblings on the way, from the lowest level up, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s.left, s.right)), ""))


def proven(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, key, digest and any more columns) with subroot, root and steps."""
    nodes = saved(indexed(leaves, "key", "digest"))
    levels = levels_of(nodes)
    groups = numbered(tops_of(nodes, levels), [F.col("grp")])
    groups = saved(groups.select(F.col("grp").alias("member"), "digest", F.col(ROW).cast("long").alias("idx")))
    over = groups.select("member", F.lit("").alias("grp"), F.lit(groups.count()).cast("long").alias("n"), "idx", "digest")
    upper = levels_of(over)
    root = tops_of(over, upper).select("grp", F.col("digest").alias("root"))
    tops = with_steps(over, upper, root.withColumn("above", F.array().cast(STEPS)))
    tops = tops.select(F.col("member").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("above"))
    return with_steps(nodes, levels, saved(tops)).drop("n")


def manifest(docs: DataFrame, columns: Sequence[str], group: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with leaf, subroot, root and steps, the array of (left, right) that leads from a leaf to the root (leaf_1, ...
    if there are such columns). ``columns`` are what a leaf holds, in order."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    leaves = docs.select(group_key(F.col(f"`{group}`")).alias("grp"), F.col(f"`{key}`").alias("key"), leaf([F.col(f"`{c}`") for c in columns]).alias("digest"), row)
    named = {n: fresh(docs, n) for n in ("leaf", "subroot", "root", "steps")}
    return proven(saved(leaves)).select("row.*", *[F.col("digest" if n == "leaf" else n).alias(to) for n, to in named.items()])


def verified(made: DataFrame, columns: Sequence[str]) -> Column:
    """For a table with the columns of ``manifest``: whether the row's own columns give the root through its siblings."""
    return folded(leaf([F.col(f"`{c}`") for c in columns]), made["steps"]) == made["root"]


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its leaf, its source's subroot, the root, the digest of its proof, and what the root becomes
    if the document was tampered with (a fifth of them are, by a hash of the id: capitals A-Z are lowered)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    own = leaf([F.col(c) for c in LEAF])
    other = F.when(hit, leaf([lowered if c == "text" else F.col(c) for c in LEAF])).otherwise(own)
    leaves = docs.select(group_key(F.col("source")).alias("grp"), F.col("doc_id").alias("key"), own.alias("digest"), other.alias("given"))
    made = proven(saved(leaves)).withColumn("folded_root", folded(F.col("given"), F.col("steps")))
    return made.select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("steps")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in LEAF) + ")"


OP13_SQL = f"""
WITH RECURSIVE {CRC32.strip()},
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS lowered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT 0 AS lv, source, idx, n, leaf AS d FROM placed
  UNION ALL
  SELECT lv + 1, source, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes
  WHERE n > 1 GROUP BY lv, source, n, idx // {FANOUT}),
steps AS (
  SELECT lv, source, idx, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY lv, source, idx // {FANOUT} ORDER BY idx)),
subroots AS (SELECT source, d AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lv, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, subroot AS d, source FROM subroots
  UNION ALL
  SELECT lv + 1, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY idx)), NULL FROM tops
  WHERE n > 1 GROUP BY lv, n, idx // {FANOUT}),
top_steps AS (
  SELECT lv, idx, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY lv, idx // {FANOUT} ORDER BY idx)),
fold AS (
  SELECT r, 0 AS lv, source, idx, coalesce(lowered, leaf) AS d, '' AS proof FROM placed
  UNION ALL
  SELECT f.r, f.lv + 1, f.source, f.idx // {FANOUT}, sha256(s.l || f.d || s.r), f.proof || s.l || s.r
  FROM fold f JOIN steps s ON s.lv = f.lv AND s.idx = f.idx AND s.source IS NOT DISTINCT FROM f.source),
folded AS (SELECT r, source, arg_max(d, lv) AS d, arg_max(proof, lv) AS proof FROM fold GROUP BY r, source),
top_fold AS (
  SELECT f.r, 0 AS lv, t.idx, f.d, f.proof FROM folded f JOIN tops t ON t.lv = 0 AND t.source IS NOT DISTINCT FROM f.source
  UNION ALL
  SELECT f.r, f.lv + 1, f.idx // {FANOUT}, sha256(s.l || f.d || s.r), f.proof || s.l || s.r
  FROM top_fold f JOIN top_steps s ON s.lv = f.lv AND s.idx = f.idx),
ends AS (SELECT r, arg_max(d, lv) AS d, arg_max(proof, lv) AS proof FROM top_fold GROUP BY r),
root AS (SELECT d AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
FROM placed p JOIN ends e USING (r) JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source, root
"""
