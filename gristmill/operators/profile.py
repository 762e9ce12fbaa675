"""What a table holds: an overview, a column's profile, and the columns that a question most likely means."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.formatting import unit_symbol
from ..functions.values import kind_of, number_text, text_of
from . import distinct
from .analyses import distinct_counts, grouping_columns, nested_steps
from .cleaning import data_columns
from .stats import describe, num
from .summarize import first_frequencies

# Fixed patterns: names that mean amounts, most likely first; names of identifiers; names of people or accounts.
MEASURES = (
    r"revenue|sales|turnover|income|profit|amount|spend|spent|total",
    r"cost|price|value|budget|fee",
    r"orders?|quantity|qty|units|customers|visitors|visits|score|count",
)
NOT_MEASURED = r"(^|[\s_])(id|no|number|code|index|year|month|day|lat|lon|latitude|longitude)$"
NUMBERED = r"(^|[\s_])(id|no|number|code|member|customer_?id)$"
PEOPLE = r"customer|client|user|member|email|account|name|id"
#: Share of rows that share a unit for a column to have it.
ONE_UNIT = 0.8


def overview(df: DataFrame) -> DataFrame:
    """(column_name, kind, missing, distinct_values) of all columns; distinct values are exact."""
    names = data_columns(df)
    found = distinct.exact(df, names)
    rows = [(c, kind_of(df, c), found[c].missing, found[c].values) for c in names]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string, missing long, distinct_values long")


def profile(df: DataFrame, column: str, top: int = 10) -> dict[str, Any]:
    """A column's missing and distinct values with its statistics (numbers), ends (dates) or most frequent values."""
    kind, c = kind_of(df, column), F.col(f"`{column}`")
    n, missing, kinds, low, high = df.agg(F.count("*"), F.count_if(c.isNull()), F.count_distinct(c), F.min(c), F.max(c)).first()
    out: dict[str, Any] = {"kind": kind, "rows": n, "missing": missing, "distinct": kinds}
    if kind == "number":
        return out | (describe(df, [column]).first().asDict() if n > missing else {})
    if kind == "date":
        return out | {"low": low, "high": high}
    return out | {"values": [(r["value"], r["n"]) for r in first_frequencies(df, column, top).collect()]}


def default_measure(df: DataFrame) -> str | None:
    """The number column that "how much" most likely means; never an identifier. None: count rows."""
    numbers = [c for c in data_columns(df) if kind_of(df, c) == "number" and not re.search(NOT_MEASURED, c.strip(), re.I)]
    named = next((c for words in MEASURES for c in numbers if re.search(words, c, re.I)), None)
    if named or not numbers:
        return named
    filled = df.agg(*[F.bool_or(F.coalesce(num(c) != 0, F.lit(False))).alias(f"f{i}") for i, c in enumerate(numbers)]).first()
    return next((c for c, f in zip(numbers, filled, strict=True) if f), None)


def id_columns(df: DataFrame) -> list[str]:
    """Columns that say whom a row is about: five values or more, some repeated, at least one for fifty rows. Number
    columns only if they are called so; likely names first."""
    names = [c for c in data_columns(df) if kind_of(df, c) in ("category", "text") or kind_of(df, c) == "number" and re.search(NUMBERED, c.strip(), re.I)]
    kinds = distinct_counts(df, names)
    if not names:
        return []
    present = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)]).first()
    found = [c for i, c in enumerate(names) if 5 <= kinds[c] < present[f"n{i}"] and kinds[c] >= 0.02 * present["rows"]]
    return sorted(found, key=lambda c: not re.search(PEOPLE, c, re.I))


def unit_of(df: DataFrame, column: str) -> str | None:
    """The currency or percent sign that most of a number column's texts have."""
    symbol = unit_symbol(text_of(df, column))
    found = df.where(text_of(df, column).isNotNull()).groupBy(symbol.alias("u")).agg(F.count("*").alias("n"))
    rows = found.collect()  # five units at most, and none
    total = sum(r["n"] for r in rows)
    return next((r["u"] for r in rows if r["u"] and r["n"] >= ONE_UNIT * total), None)


def suggest_chart(df: DataFrame, x: str, y: str | None = None) -> str:
    """The chart that fits two columns' kinds."""
    kinds = kind_of(df, x), kind_of(df, y) if y else None
    if kinds[0] == "date":
        return "line"
    if kinds == ("number", "number"):
        return "scatter"
    if kinds[0] == "number" and y is None:
        return "histogram"
    return "box" if "number" in kinds and kinds[0] != "number" and y else "bar"


def choices(df: DataFrame, column: str, options: Sequence[str], separator: str = "; ") -> DataFrame:
    """(option, n) of answers in which several options may be ticked; options that nobody ticked count 0."""
    picked = df.where(F.col(f"`{column}`").isNotNull()).select(F.explode(F.split(F.col(f"`{column}`"), separator)).alias("option"))
    counted = picked.groupBy("option").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(o,) for o in options], "option string")
    return every.join(counted, "option", "left").select("option", F.coalesce("n", F.lit(0)).alias("n"))


def field_summary(answers: DataFrame, field: dict[str, Any], values: str = "values", order: str = "received") -> dict[str, Any]:
    """A form field (id, type, perhaps options or scale) over all answers, a column of JSON objects by field id.

    ``answered`` and ``total``; the mean, least and most of numbers and ratings; ``counts`` of all options, ratings or
    yes and no, those that nobody chose too; the three ``latest`` texts or dates, last first.
    """
    raw = F.get_json_object(values, f"$['{field['id']}']")
    held = answers.select(raw.alias("v"), F.col(order).alias("at"))
    given = F.col("v").isNotNull() & (F.col("v") != "[]")
    x = F.col("v").try_cast("double")
    total, answered, mean, low, high = held.agg(F.count("*"), F.count_if(given), F.avg(F.when(given, x)), F.min(F.when(given, x)), F.max(F.when(given, x))).first()
    out: dict[str, Any] = {"answered": answered, "total": total}
    kind = field["type"]
    if kind in ("number", "rating"):
        out |= {"mean": mean, "min": low, "max": high}
    if kind in ("choice", "checkboxes", "yesno", "rating"):
        options = {"yesno": ["true", "false"], "rating": [str(k) for k in range(1, field.get("scale", 5) + 1)]}.get(kind) or list(field["options"])
        many = F.from_json("v", "array<string>") if kind == "checkboxes" else F.array(number_text(x) if kind == "rating" else F.col("v"))
        each = held.where(given).select(F.explode(many).alias("o")).where(F.col("o").isin(*options)).groupBy("o").agg(F.count("*").alias("n"))
        found = {r["o"]: r["n"] for r in each.collect()}
        label = {"true": "Yes", "false": "No"} if kind == "yesno" else {}
        out["counts"] = [(label.get(o, o), found.get(o, 0)) for o in options]
    if kind in ("text", "paragraph", "email", "date"):
        out["latest"] = [r["v"] for r in held.where(given).orderBy(F.desc("at")).limit(3).collect()]
    return out


def applicable(df: DataFrame) -> dict[str, str | None]:
    """Each analysis by name: None if the table fits it, else what it needs."""
    kinds = {c: kind_of(df, c) for c in data_columns(df)}
    dates, numbers = "date" in kinds.values(), [c for c, k in kinds.items() if k == "number" and not re.search(NOT_MEASURED, c.strip(), re.I)]
    groups = grouping_columns(df.select(*[F.col(f"`{c}`") for c in kinds]))
    labels = [c for c, k in kinds.items() if k == "category"]
    wordy = [F.bool_or(F.size(F.split(F.trim(F.col(f"`{c}`")), r"\s+")) >= 3) for c in labels]
    written = "text" in kinds.values() or bool(labels) and any(df.agg(*[w.alias(f"w{i}") for i, w in enumerate(wordy)]).first())
    flags = [c for c, k in kinds.items() if k == "boolean"]
    need = {
        "change": (dates, "a date column"),
        "compare": (groups, "a category or yes/no column"),
        "drivers": (len(kinds) >= 2, "at least two columns"),
        "top": (groups or "text" in kinds.values(), "a category column"),
        "unusual": (dates, "a date column"),
        "trend": (dates, "a date column"),
        "whatif": (numbers, "a number column to predict"),
        "groups": (len(numbers) >= 2, "two or more number columns"),
        "delay": (dates and len(numbers) >= 2, "two number columns" if dates else "a date column"),
        "returns": (dates and id_columns(df), "a customer or member column with repeat visits" if dates else "a date column"),
        "funnel": (len(flags) >= 2 and nested_steps(df, flags), "yes/no columns for steps that follow one another"),
        "themes": (written, "a column of written answers"),
    }
    return {name: None if fits else f"needs {what}" for name, (fits, what) in need.items()}
