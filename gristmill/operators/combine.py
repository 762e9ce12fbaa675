"""Joins on one key whatever its spelling, stacking by column name, and reports about both."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.values import RAW, has_raw, join_key
from ..sources.text import Kind, Profile, decided, different, kinds, profiles, typed
from . import skew
from .cleaning import data_columns, unique_name
from .sorting import ROW
from .storage import saved

HOW = ("left", "inner", "full")


def _keyed(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.withColumn(name, join_key(df, key))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", right_name: str = "other") -> DataFrame:
    """Left, inner or full join. Keys match by number or without case; missing keys never match; repeated keys multiply.

    The right key column goes; clashing names get the right table's name. In a full join an unmatched right row keeps
    its key in the left key column. The key is a column of its own, so Spark may broadcast the small side or split
    skewed keys; it does not split those of full joins, so their keys of very many rows are dealt in pieces. Of two tables that were read from text, the texts are joined and their kinds read off anew.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    texts = as_texts(left), as_texts(right)
    if texts[0] is not None and texts[1] is not None:
        return reread(left, saved(join(*texts, left_key, right_key, how, right_name)))  # joined once, read as often as needed
    taken, names = list(left.columns), {}
    for c in data_columns(right):
        if c != right_key:
            names[c] = unique_name(taken, c if c not in taken else f"{c} ({right_name})")
            taken.append(names[c])
    own = _keyed(left, left_key, "_lk")
    kept = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    other = _keyed(right, right_key, "_rk").select("_rk", F.col(f"`{right_key}`").alias("_right_key"), *kept)
    out = skew.join(own, other, "_lk", "_rk", how) if how == "full" else own.join(other, F.col("_lk") == F.col("_rk"), how)
    if how == "full":
        t = left.schema[left_key].dataType
        filled = F.when(F.col("_lk").isNull() & F.col("_rk").isNotNull(), F.col("_right_key").try_cast(t)).otherwise(F.col(f"`{left_key}`"))
        out = out.withColumn(left_key, filled)
    return out.drop("_lk", "_rk", "_right_key")


def preview(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row of counts about a join without making it: rows of both, matched and not, and rows of each kind of result.

    Both sides are counted by key first, so a hot key is one row."""
    a = _keyed(left, left_key, "k").groupBy("k").agg(F.count("*").alias("a"))
    b = _keyed(right, right_key, "j").groupBy("j").agg(F.count("*").alias("b"))
    both = a.join(b, F.col("k") == F.col("j"), "full")
    one = lambda c: F.coalesce(c, F.lit(0))
    matched = F.col("a").isNotNull() & F.col("b").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pairs = F.when(matched, F.col("a") * F.col("b"))
    return both.agg(
        total("a").alias("left_rows"),
        total(F.when(matched, F.col("a"))).alias("matched_left"),
        total(F.when(~matched, one(F.col("b")))).alias("unmatched_right"),
        F.count_if(matched & (F.col("b") > 1)).alias("duplicate_keys"),
        total(pairs).alias("inner_rows"),
        total(F.coalesce(pairs, F.col("a"))).alias("left_result_rows"),
        total(F.coalesce(pairs, one(F.col("a")) + one(F.col("b")))).alias("full_rows"),
    )


def suggest_keys(left: DataFrame, right: DataFrame, rows: int = 5000) -> list[tuple[str, str, float]]:
    """Pairs of columns by how well they would join, best first, judged on the first rows of each side.

    The score is the share of the right column's keys that the left one has, 1 more for equal names, and 0.25 more for a
    right column of almost only different keys. A left column needs two keys.
    """
    sets: list[dict[str, tuple[set[str], int]]] = []
    for df in (left, right):
        head = df.limit(rows)
        names = data_columns(df)
        made = head.agg(*[F.collect_set(join_key(df, c)).alias(f"c{i}") for i, c in enumerate(names)], F.count("*").alias("n")).first()
        sets.append({c: (set(made[i]), made["n"]) for i, c in enumerate(names)})
    found = []
    for a, (x, _) in sets[0].items():
        for b, (y, n) in sets[1].items():
            if len(x) >= 2 and (hits := len(x & y)):
                found.append((a, b, hits / len(y) + (same_name(a, b)) + 0.25 * (len(y) > 0.9 * max(1, n))))
    return sorted(found, key=lambda f: -f[2])


def same_name(a: str, b: str) -> bool:
    return a.strip().lower() == b.strip().lower()


def as_texts(df: DataFrame) -> DataFrame | None:
    """A table that was read from text as the texts of all its columns; None if some column has none."""
    names = data_columns(df)
    if not names or not all(has_raw(df, c) for c in names):
        return None
    rest = [F.col(ROW)] if ROW in df.columns else []
    return df.select(*rest, *[F.col(RAW)[c].alias(c) for c in names])


def reread(base: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts``, joined or stacked, with the kinds of its columns read off all its texts anew; a column of ``base`` whose
    kind was chosen keeps it."""
    names = data_columns(texts)
    filled = texts.select(*[c for c in texts.columns if c not in names], *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    known = kinds(filled.select(*[F.col(f"`{c}`") for c in names]))
    chosen = {f.name: f.metadata["kind"] for f in base.schema.fields if f.metadata.get("chosen")}
    return typed(filled, {c: Kind(chosen[c], k.day_first, k.decimal_comma) if c in chosen else k for c, k in known.items()})


@dataclass(frozen=True)
class Profiled:
    """A table that was read from text with the profiles of its columns, so that more rows can be appended without another
    look at those it has. It stands for all rows that were profiled: after rows are taken out, make it anew."""

    table: DataFrame
    profiles: dict[str, Profile]

    @staticmethod
    def of(texts: DataFrame) -> Profiled:
        """A table of texts with its columns read."""
        found, known = decided(profiles(texts), lambda columns: different(texts, columns))
        return Profiled(typed(texts, found), known)

    def append(self, other: Profiled, source: str | None = None, base_label: str = "base", other_label: str = "other") -> Profiled:
        """``append``, with kinds by the profiles of both. No rows are read, but for columns of short texts whose number of
        different values the two cannot tell."""
        texts = append(as_texts(self.table), as_texts(other.table), source, base_label, other_label)
        names = data_columns(texts)
        filled = texts.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in names else F.col(c) for c in texts.columns])
        theirs = {plain(c): p for c, p in other.profiles.items()}
        made = {c: self.profiles.get(c, Profile()).with_rows_of(theirs.get(plain(c), Profile())) for c in names}
        fresh = [c for c in names if plain(c) not in {plain(x) for x in (*self.profiles, *other.profiles)}]
        if fresh:  # the column that names the table of a row
            made |= profiles(filled.select(*[F.col(f"`{c}`") for c in fresh]))
        found, known = decided(made, lambda columns: different(filled, columns))
        chosen = {f.name: f.metadata["kind"] for f in self.table.schema.fields if f.metadata.get("chosen")}
        found = {c: Kind(chosen[c], k.day_first, k.decimal_comma) if c in chosen else k for c, k in found.items()}
        return Profiled(typed(filled, found), known)


def plain(name: str) -> str:
    """A column name without case and blanks."""
    return re.sub(r"\s+", "", name.lower())


def match_columns(base: list[str], other: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(in both, only in base, only in other)."""
    a, b = {plain(c) for c in base}, {plain(c) for c in other}
    return [c for c in base if plain(c) in b], [c for c in base if plain(c) not in b], [c for c in other if plain(c) not in a]


def append(base: DataFrame, other: DataFrame, source: str | None = None, base_label: str = "base", other_label: str = "other") -> DataFrame:
    """Rows of both; columns match by name without case and blanks, others are kept and empty where missing.

    ``source`` names a column that says where a row came from. The texts of tables that were read from text are stacked
    and their kinds read off anew."""
    texts = as_texts(base), as_texts(other)
    if texts[0] is not None and texts[1] is not None:
        return reread(base, append(*texts, source, base_label, other_label))
    named = {plain(c): c for c in base.columns}
    renamed = other.select(*[F.col(f"`{c}`").alias(named.get(plain(c), c)) for c in other.columns])
    if source:
        at = next((c for c in base.columns if plain(c) == plain(source)), None)
        name = at if at and at not in renamed.columns else unique_name(base.columns, source)
        if name != at:
            base = base.withColumn(name, F.lit(base_label))
        renamed = renamed.withColumn(name, F.lit(other_label))
    return base.unionByName(renamed, allowMissingColumns=True)
