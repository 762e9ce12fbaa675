"""Health of a table, spellings, what goes with a column, and facts worth telling."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.formatting import number as shown
from ..functions.formatting import share as percent
from ..functions.values import has_raw, is_missing, kind_of, parse_date, parse_number, text_of, trimmed
from .analyses import distinct_counts
from .cleaning import count_duplicates, data_columns, put
from .significance import MOST_LEVELS, anova_of, chi_square_from, correlation_of
from .quantiles import of_columns
from .stats import correlations, num, pearson
from .summarize import number

#: Points that an issue takes from 100, by its severity.
COST = {"high": 15, "medium": 8, "low": 3}
#: Share of texts that read as another kind, from which the column is said to be of it.
OTHER_KIND = 0.6


@dataclass(frozen=True)
class Issue:
    kind: str
    column: str | None
    severity: str
    rows: int
    fix: dict

    #: Fixes that lose nothing.
    SAFE = ("duplicates", "empty", "variants", "spaces")

    @property
    def safe(self) -> bool:
        return self.kind in Issue.SAFE


def spelling_variants(df: DataFrame, column: str) -> DataFrame:
    """(variant, wanted, n): spellings that differ from the commonest one in capitals or blanks only.

    Of equally common ones the tidy one wins, then the first of them by text. Texts are counted before they are
    grouped, so a common value is one row.
    """
    text = text_of(df, column)
    counts = df.select(text.alias("s")).where(~is_missing(F.col("s"))).groupBy("s").agg(F.count("*").alias("n"))
    tidy = F.regexp_replace(trimmed(F.col("s")), r"(?U)\s+", " ")
    keyed = counts.select("s", "n", tidy.alias("tidy"), F.lower(tidy).alias("k"))
    first = keyed.groupBy("k").agg(F.count("*").alias("forms"), F.min_by("tidy", F.struct((-F.col("n")).alias("n"), (F.col("s") != F.col("tidy")).alias("t"), "s")).alias("wanted"))
    joined = keyed.join(first.where("forms > 1"), "k")
    return joined.where("s != wanted").select(F.col("s").alias("variant"), "wanted", "n")


def merge_spellings(df: DataFrame, column: str) -> DataFrame:
    """``df`` with every spelling variant of ``column`` replaced by the wanted one, by a join, however many there are."""
    found = spelling_variants(df, column).select(F.col("variant").alias("_variant"), F.col("wanted").alias("_wanted"))
    joined = df.withColumn("_text", text_of(df, column)).join(found, F.col("_text") == F.col("_variant"), "left")
    return put(joined, column, F.coalesce("_wanted", F.col(f"`{column}`"))).drop("_text", "_variant", "_wanted")


def health(df: DataFrame) -> list[Issue]:
    """What is wrong with a table, worst first. All counts of all columns come from one job; repeats and spellings of
    label columns from one more each."""
    names = data_columns(df)
    kinds = {c: kind_of(df, c) for c in names}
    checks = {}
    for i, c in enumerate(names):
        v, raw = F.col(f"`{c}`"), text_of(df, c)
        present = ~is_missing(raw)
        checks |= {f"missing{i}": F.count_if(v.isNull()), f"same{i}": F.min(raw) == F.max(raw)}
        if kinds[c] == "number" and has_raw(df, c):
            checks[f"unread{i}"] = F.count_if(v.isNull() & present)
        if kinds[c] in ("category", "text"):
            checks |= {
                f"present{i}": F.count_if(present), f"number{i}": F.count_if(present & parse_number(raw).isNotNull()),
                f"date{i}": F.count_if(present & parse_date(raw).isNotNull()), f"spaced{i}": F.count_if(raw.rlike(r"^\s|\s$|\s{2}")),
            }
    found = df.agg(F.count("*").alias("rows"), *[x.alias(k) for k, x in checks.items()]).first().asDict()
    n = found["rows"]
    issues: list[Issue] = []
    if not n:
        return issues
    repeats = count_duplicates(df.select(*names) if len(names) < len(df.columns) else df).first()[0]
    if repeats:
        issues.append(Issue("duplicates", None, "high", repeats, {"op": "removeDuplicates"}))
    for i, c in enumerate(names):
        missing = found[f"missing{i}"]
        if missing == n:
            issues.append(Issue("empty", c, "medium", n, {"op": "delete", "column": c}))
            continue
        if missing >= 0.8 * n:
            issues.append(Issue("sparse", c, "low", missing, {"op": "delete", "column": c}))
        elif missing and kinds[c] == "number":
            issues.append(Issue("missing", c, "medium" if found.get(f"unread{i}") else "low", missing, {"op": "fillMissing", "column": c, "method": "median"}))
        if kinds[c] in ("category", "text"):
            total = max(1, found[f"present{i}"])
            other = next((k for k in ("number", "date") if found[f"{k}{i}"] >= OTHER_KIND * total), None)
            if other:
                issues.append(Issue("type", c, "high", total - found[f"{other}{i}"], {"op": "setType", "column": c, "type": other}))
                continue
            variants = spelling_variants(df, c).agg(F.sum("n")).first()[0] if kinds[c] == "category" else None
            if variants:
                issues.append(Issue("variants", c, "medium", variants, {"op": "standardize", "column": c}))
            elif found[f"spaced{i}"]:
                issues.append(Issue("spaces", c, "low", found[f"spaced{i}"], {"op": "text", "column": c, "how": "trim"}))
        if n > 1 and not missing and kinds[c] != "text" and found[f"same{i}"]:
            issues.append(Issue("constant", c, "low", n, {"op": "delete", "column": c}))
    return sorted(issues, key=lambda x: list(COST).index(x.severity))


def score(issues: Sequence[Issue]) -> int:
    """0 to 100."""
    return max(0, 100 - sum(COST[i.severity] for i in issues))


@dataclass(frozen=True)
class Driver:
    column: str
    strength: float  # share of the variation explained
    p: float
    method: str


def drivers(df: DataFrame, target: str) -> list[Driver]:
    """Columns by how much of the target's variation they explain: r² of numbers, eta² of groups, V² of two labels.

    Dates, free text and labels that are unique are left out, as are more than 30 groups.
    """
    names = [c for c in data_columns(df) if c != target and kind_of(df, c) in ("number", "category", "boolean")]
    counts = distinct_counts(df, [c for c in names if kind_of(df, c) != "number"])
    present = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in counts]).first().asDict() if counts else {}
    out = []
    usable = [c for c in names if not (c in counts and present[c] > 10 and counts[c] == present[c])]
    of_number = kind_of(df, target) == "number"
    numbers = [c for c in usable if kind_of(df, c) == "number"]
    groups = [c for c in usable if kind_of(df, c) != "number"]
    y = F.col(f"`{target}`")
    if of_number and numbers:
        pairs = [(pearson(num(c), num(target)), F.count_if(num(c).isNotNull() & num(target).isNotNull())) for c in numbers]
        found = df.agg(*[x.alias(f"{k}{i}") for i, p in enumerate(pairs) for k, x in zip("rn", p, strict=True)]).first()
        for i, c in enumerate(numbers):
            if made := correlation_of(found[f"r{i}"], found[f"n{i}"]):
                out.append(Driver(c, made.r**2, made.p, "correlation"))
    # labels and numbers are stacked, so each of the two jobs below serves all columns
    measured = [(c, target) for c in groups] if of_number else [(target, c) for c in numbers]
    if measured:
        rows = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{g}`").cast("string").alias("g"), number(df, v).alias("x")) for i, (g, v) in enumerate(measured)])
        held = df.select(F.inline(rows)).where("g IS NOT NULL AND x IS NOT NULL")
        per = held.groupBy("i", "g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v")).where("n >= 2")
        sums = per.groupBy("i").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("total"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
        few = {r["i"]: r for r in sums.where(F.col("k").between(2, MOST_LEVELS)).collect()}
        means = F.create_map(*[F.lit(x) for i, r in few.items() for x in (i, r["total"] / r["n"])]) if few else None
        apart = per.groupBy("i").agg(F.sum(F.col("n") * F.pow(F.col("m") - means[F.col("i")], F.lit(2))).alias("between")).collect() if few else []
        for i, between in apart:
            if i in few and (made := anova_of(few[i]["n"], few[i]["k"], between, few[i]["within"])):
                out.append(Driver(measured[i][0 if of_number else 1], made.eta2, made.p, "group comparison"))
    crossed = [c for c in groups if not of_number and counts[c] <= MOST_LEVELS]
    if crossed and df.select(y).where(y.isNotNull()).distinct().limit(MOST_LEVELS + 1).count() <= MOST_LEVELS:
        rows = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("b")) for i, c in enumerate(crossed)])
        cells = df.where(y.isNotNull()).select(y.cast("string").alias("a"), F.inline(rows)).where("b IS NOT NULL").groupBy("i", "a", "b").count()
        tables: dict[int, list[tuple]] = {}
        for r in cells.collect():  # at most 30 x 30 cells a column
            tables.setdefault(r["i"], []).append((r["a"], r["b"], r["count"]))
        for i, table in tables.items():
            if made := chi_square_from(table):
                out.append(Driver(crossed[i], made.v**2, made.p, "association"))
    return sorted(out, key=lambda d: -d.strength)


@dataclass(frozen=True)
class Fact:
    kind: str
    columns: tuple[str, ...]
    value: float


#: Fixed pattern: names of number columns that may be ids.
ID_NAME = r"(?i)(^|[\s_-])(id|code|key|no)$|^id([\s_-]|$)"


def facts(df: DataFrame) -> list[Fact]:
    """Facts worth telling, in this order.

    Pairs of numbers that go together (|r| of 0.4 or more, three at most); skewed numbers; numbers with a few outliers
    (two at most); labels of one value and those that most rows share (80 % or more); the number and label of at most 12
    groups whose means are furthest apart, in deviations of the number; columns with missing values (four at most, most
    first; the value is the share), or that there are none; repeated rows; the span of dates in days; and unique columns
    that look like ids. Each kind is one or two jobs for all columns.
    """
    names = data_columns(df)
    kinds = {c: kind_of(df, c) for c in names}
    numbers, labels = [c for c in names if kinds[c] == "number"], [c for c in names if kinds[c] in ("category", "boolean")]
    dates, ids = [c for c in names if kinds[c] == "date"], [c for c in names if kinds[c] == "text" or kinds[c] == "number" and re.search(ID_NAME, c)]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    wanted = {"rows": F.count("*")} | {f"n{i}": F.count(F.col(f"`{c}`")) for i, c in enumerate(names)}
    for i, c in enumerate(numbers):
        wanted |= {f"skew{i}": F.skewness(num(c)), f"varied{i}": F.min(num(c)) < F.max(num(c)), f"std{i}": F.stddev_samp(num(c))}
    wanted |= {f"span{i}": F.datediff(F.max(F.col(f"`{c}`")), F.min(F.col(f"`{c}`"))) for i, c in enumerate(dates)}
    seen = df.agg(*[x.alias(k) for k, x in wanted.items()]).first().asDict()
    rows = seen["rows"]
    if not rows:
        return []
    present = {c: seen[f"n{i}"] for i, c in enumerate(names)}
    order = {p: i for i, p in enumerate(pairs)}
    strong = correlations(df, numbers).where(F.abs("r") >= 0.4).orderBy(F.desc(F.abs("r"))).limit(3 + len(numbers)).collect()
    close = sorted(((r["r"], (r["x"], r["y"])) for r in strong), key=lambda x: (-abs(x[0]), order[x[1]]))
    out = [Fact("correlation", p, r) for r, p in close[:3]]
    usable = {c: i for i, c in enumerate(numbers) if present[c] >= 8 and seen[f"varied{i}"]}
    out += [Fact("skew", (c,), seen[f"skew{i}"]) for c, i in usable.items() if seen[f"skew{i}"] is not None and abs(seen[f"skew{i}"]) >= 1]
    fences = {c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in of_columns(df, {c: num(c) for c in usable}, (0.25, 0.75)).items()}
    if fences:
        beyond = df.agg(*[F.count_if((num(c) < a) | (num(c) > b)).alias(f"o{i}") for i, (c, (a, b)) in enumerate(fences.items())]).first()
        few = sorted(((x / present[c], c) for x, c in zip(beyond, fences, strict=True) if 0 < x <= 0.1 * present[c]), key=lambda x: -x[0])
        out += [Fact("outliers", (c,), x) for x, c in few[:2]]
    held = long_values(df, labels).groupBy("i", "v").count() if labels else None
    shares = {r["i"]: r for r in held.groupBy("i").agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("k")).collect()} if labels else {}
    for i, c in enumerate(labels):
        if i in shares:
            most, every, k = shares[i]["most"], shares[i]["all"], shares[i]["k"]
            if k == 1 and every == rows:
                out.append(Fact("constant", (c,), 1.0))
            elif k > 1 and most >= 0.8 * every:
                out.append(Fact("dominant", (c,), most / every))
    small = [c for i, c in enumerate(labels) if i in shares and shares[i]["k"] + (shares[i]["all"] < rows) <= 12]
    if small and numbers:
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(small)])
        means = df.select(F.inline(each), *[num(c).alias(f"x{j}") for j, c in enumerate(numbers)]).where("v IS NOT NULL").groupBy("i", "v")
        of = means.agg(*[F.when(F.count(f"x{j}") >= 5, F.avg(f"x{j}")).alias(f"m{j}") for j in range(len(numbers))])
        spread = of.groupBy("i").agg(*[(F.max(f"m{j}") - F.min(f"m{j}")).alias(f"d{j}") for j in range(len(numbers))]).orderBy("i").collect()
        gaps_of = [(r[f"d{j}"] / seen[f"std{j}"], (numbers[j], small[r["i"]])) for r in spread for j in range(len(numbers)) if r[f"d{j}"] and seen[f"std{j}"]]
        if gaps_of and (best := max(gaps_of, key=lambda x: x[0]))[0] >= 0.5:
            out.append(Fact("difference", best[1], best[0]))
    gaps = sorted(((rows - n, c) for c, n in present.items() if n < rows), key=lambda x: -x[0])
    out += [Fact("missing", (c,), k / rows) for k, c in gaps[:4]] or [Fact("complete", (), 0.0)]
    if repeats := count_duplicates(df.select(*names) if len(names) < len(df.columns) else df).first()[0]:
        out.append(Fact("duplicates", (), float(repeats)))
    full = [c for c in ids if rows >= 20 and present[c] == rows]
    unique = {r["i"] for r in long_values(df, full).groupBy("i", "v").count().groupBy("i").agg(F.max("count").alias("most")).where("most = 1").collect()} if full else set()
    for c in names:
        if c in dates and seen[f"span{dates.index(c)}"] is not None:
            out.append(Fact("span", (c,), float(seen[f"span{dates.index(c)}"])))
        elif c in full and full.index(c) in unique:
            out.append(Fact("id", (c,), 1.0))
    return out


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, v): the values of the columns by their number, as texts, without nulls."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])
    return df.select(F.inline(each)).where("v IS NOT NULL")


def sentence(fact: Fact) -> str:
    """A fact as it is told."""
    a, b = (*fact.columns, "", "")[:2]
    v = fact.value
    return {
        "missing": lambda: f"{percent(v) if v >= 0.01 else 'Under 1%'} of the values of {a} are missing.",
        "complete": lambda: "No value is missing.",
        "duplicates": lambda: f"{shown(v)} rows repeat an earlier one.",
        "correlation": lambda: f"{a} and {b} tend to {'rise together' if v > 0 else 'move in opposite directions'} (r = {v:.2f}).",
        "skew": lambda: f"{a} has a long tail of {'large' if v > 0 else 'small'} values, so the median says more than the average.",
        "outliers": lambda: f"{percent(v) if v >= 0.01 else 'Under 1%'} of the values of {a} are far from the rest.",
        "constant": lambda: f"{a} has the same value in all rows.",
        "dominant": lambda: f"{percent(v)} of the rows have the same {a}.",
        "difference": lambda: f"The average {a} differs by {v:.1f} deviations between groups of {b}.",
        "span": lambda: f"{a} spans {shown(v)} days.",
        "id": lambda: f"{a} looks like an id: every value is unique.",
    }[fact.kind]()


def story(df: DataFrame, measure: str | None = None) -> list[str]:
    """A table in a few sentences: its size, its health, what goes with a measure, and the facts worth telling."""
    n, names = df.count(), data_columns(df)
    issues = health(df)
    out = [f"The table has {shown(n)} rows and {len(names)} columns.", f"Its health is {score(issues)} of 100" + (f", with {len(issues)} issues." if issues else ".")]
    best = drivers(df, measure)[:1] if measure else []
    out += [f"{d.column} explains most of {measure}: {percent(d.strength)} of its variation." for d in best if d.strength >= 0.02]
    return out + [sentence(f) for f in facts(df)]
