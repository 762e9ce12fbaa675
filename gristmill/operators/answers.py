"""Stored questions: small specifications that are answered anew over whatever the table holds now.

A specification is a dictionary: ``filters`` (column, op, value) and ``result`` with ``kind`` value, summary, chart or
drivers. Reports and dashboards are lists of them. Columns are named, so one that is gone is an error of that item only.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.values import kind_of
from . import charts, insights, sorting, stats
from .filters import Filter, where
from .summarize import Agg, group, ordered, summarised

SHOWN, SHOWN_IN_REPORTS = 12, 25


def filters_of(spec: dict[str, Any]) -> list[Filter]:
    return [Filter(f["column"], f["op"], f.get("value")) for f in spec.get("filters", ())]


def missing_columns(df: DataFrame, spec: dict[str, Any]) -> list[str]:
    """Columns that a specification names and the table does not have."""
    result = spec["result"]
    named = [*[f["column"] for f in spec.get("filters", ())], *[result.get(k) for k in ("column", "by", "x", "y", "colour", "target")]]
    return sorted({c for c in named if c and c not in df.columns})


def answer(df: DataFrame, spec: dict[str, Any], active: Iterable[Filter] = (), shown: int = SHOWN) -> DataFrame:
    """The result as a short frame; filters of the table and of the question both hold."""
    if gone := missing_columns(df, spec):
        raise ValueError(f"Missing columns: {', '.join(gone)}")
    result = spec["result"]
    held = where(df, [*active, *filters_of(spec)])
    agg = Agg(result.get("agg", "count"), result.get("column"))
    if result["kind"] == "value":
        return summarised(held, [], [agg], ["value"], df)
    if result["kind"] == "summary":
        made = group(held, result["by"], [agg], result.get("unit", "month"), ["value"])
        if "limit" in result or "sort" in result:
            return sorting.top(made, "value", max(result.get("limit", shown), 5), result.get("sort", "desc") == "desc", "key")
        sized = group(held, result["by"], [agg, Agg()], result.get("unit", "month"), ["value", "n"])
        return ordered(sized, "key", "n", kind_of(df, result["by"]), result.get("unit")).orderBy("rank").limit(shown).drop("n")
    if result["kind"] == "chart":
        draw = {
            "line": lambda: charts.line(held, result["x"], result.get("y"), result.get("agg", "mean"), result.get("colour")),
            "bar": lambda: charts.bars(held, result["x"], result.get("y"), result.get("agg", "mean")),
            "stacked": lambda: charts.stacked(held, result["x"], result["colour"], result.get("y")),
            "box": lambda: charts.boxes(held, result["x"], result["y"]),
            "histogram": lambda: stats.histogram(held, result["x"]),
            "calendar": lambda: charts.calendar(held, result["x"], result.get("y")),
        }
        return draw[result["type"]]()
    if result["kind"] == "drivers":
        rows = [(d.column, d.strength, d.p, d.method) for d in insights.drivers(held, result["target"])]
        return df.sparkSession.createDataFrame(rows, "column_name string, strength double, p double, method string")
    raise ValueError(f"Unknown kind of result: {result['kind']}")


def report(df: DataFrame, specs: Iterable[dict[str, Any]], active: Iterable[Filter] = ()) -> list[DataFrame | str]:
    """Each item's frame, or why it cannot be answered."""
    out: list[DataFrame | str] = []
    for spec in specs:
        try:
            out.append(answer(df, spec, active, SHOWN_IN_REPORTS))
        except (ValueError, KeyError) as e:
            out.append(str(e))
    return out


def renamed(spec: dict[str, Any], old: str, new: str) -> dict[str, Any]:
    """A stored question, or an item of a report, with a column under its new name wherever it is named."""
    swap = lambda v: new if v == old else v
    out = spec | {"result": {k: swap(v) if k in ("column", "by", "x", "y", "colour", "target") else v for k, v in spec["result"].items()}}
    if "filters" in spec:
        out["filters"] = [f | {"column": swap(f["column"])} for f in spec["filters"]]
    return out


def tile_columns(df: DataFrame) -> list[str]:
    """Columns to filter a dashboard by: yes/no, and labels of 2 to 12 values."""
    names = [c for c in df.columns if kind_of(df, c) in ("boolean", "category")]
    found = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names)]).first() if names else ()
    return [c for c, n in zip(names, found, strict=True) if kind_of(df, c) == "boolean" or 2 <= n <= 12]
