"""Recipes: lists of cleaning steps as data, replayed as one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..functions.formula import calculate
from ..operators import cleaning, combine, insights
from ..operators.analyses import natural_groups
from ..operators.filters import Filter, where

Step = dict[str, Any]


def _filters(rows: Iterable[dict[str, Any]]) -> list[Filter]:
    return [Filter(r["column"], r["op"], r.get("value")) for r in rows]


STEPS: dict[str, Callable[[DataFrame, Step], DataFrame]] = {
    "removeDuplicates": lambda df, s: cleaning.remove_duplicates(df, s.get("columns"), s.get("row", cleaning.ROW)),
    "dropMissing": lambda df, s: cleaning.drop_missing(df, s.get("column")),
    "fillMissing": lambda df, s: (
        cleaning.fill_previous(df, s["column"], s.get("row", cleaning.ROW)) if s["method"] == "previous" else cleaning.fill(df, s["column"], s["method"], s.get("value"))
    ),
    "rename": lambda df, s: cleaning.rename(df, s["column"], s["name"]),
    "delete": lambda df, s: cleaning.delete(df, s["column"]),
    "setType": lambda df, s: cleaning.set_kind(df, s["column"], s["type"]),
    "text": lambda df, s: cleaning.change_text(df, s["column"], s["how"]),
    "formula": lambda df, s: calculate(df, s["name"], s["formula"]),
    "replace": lambda df, s: cleaning.replace(df, s["column"], s["find"], s["with"], s.get("exact", False), s.get("matchCase", False)),
    "standardize": lambda df, s: cleaning.standardize(df, s["column"], s["map"]) if "map" in s else insights.merge_spellings(df, s["column"]),
    "split": lambda df, s: cleaning.split(df, s["column"], s["by"]),
    "group": lambda df, s: (
        cleaning.group_top(df, s["column"], s["name"], s["top"]) if "top" in s else cleaning.group_ranges(df, s["column"], s["name"], s.get("size"))
    ),
    "dateParts": lambda df, s: cleaning.date_part(df, s["column"], s["part"], s["name"]),
    "unpivot": lambda df, s: cleaning.unpivot(df, s["columns"], s["names"], s["values"]),
    "widen": lambda df, s: cleaning.widen(df, s["from"], s["values"], s.get("mean", False), s.get("row")),
    "append": lambda df, s: combine.append(df, s["other"], s.get("source"), s.get("label", "base"), s.get("otherLabel", "other")),
    "join": lambda df, s: combine.join(df, s["other"], s["leftKey"], s["rightKey"], s.get("how", "left"), s.get("otherLabel", "other")),
    "segments": lambda df, s: cleaning.rename(natural_groups(df, s["columns"])[0], "segment", s.get("name", "segment")),
    "keepRows": lambda df, s: where(df, _filters(s["filters"])),
}
SENTENCES = {
    "removeDuplicates": "Remove repeated rows",
    "dropMissing": "Remove rows without {column}",
    "fillMissing": "Fill missing {column} with {method}",
    "rename": "Rename {column} to {name}",
    "delete": "Delete {column}",
    "setType": "Read {column} as {type}",
    "text": "Change the text of {column}: {how}",
    "formula": "Calculate {name} = {formula}",
    "replace": "Replace {find} by {with} in {column}",
    "standardize": "Merge spellings of {column}",
    "split": "Split {column} at {by}",
    "group": "Group {column} as {name}",
    "dateParts": "Take the {part} of {column} as {name}",
    "unpivot": "Turn {columns} into rows",
    "widen": "Turn values of {from} into columns",
    "append": "Add the rows of another table",
    "join": "Join another table on {leftKey}",
    "segments": "Find groups by {columns}",
    "keepRows": "Keep rows that match {filters}",
}
#: Steps that hold another table and so cannot go into a file.
NOT_PORTABLE = ("append", "join")


def apply(df: DataFrame, step: Step) -> DataFrame:
    if step["op"] not in STEPS:
        raise cleaning.StepError(f"Unknown step {step['op']}.")
    # filters on columns that are gone are ignored, as everywhere
    if gone := [] if step["op"] == "keepRows" else missing_for(df, [step]):
        raise cleaning.StepError(f'There is no column called "{gone[0]}".')
    return STEPS[step["op"]](df, step)


def described(step: Step) -> str:
    """A step in a sentence."""
    shown = {k: ", ".join(map(str, v)) if isinstance(v, list | tuple) else v for k, v in step.items()}
    if step["op"] == "keepRows":
        shown["filters"] = " and ".join(f"{f['column']} {f['op']} {f.get('value', '')}".strip() for f in step["filters"])
    if step["op"] == "dropMissing" and "column" not in shown:
        shown["column"] = "all values"
    return SENTENCES[step["op"]].format(**shown)


def renamed(step: Step, old: str, new: str) -> Step:
    """The step with a column under its new name, wherever it is named."""
    swap = lambda v: new if v == old else v
    out = {k: [swap(x) for x in v] if k == "columns" else swap(v) if k in ("column", "from", "values", "leftKey") else v for k, v in step.items()}
    if "filters" in step:
        out["filters"] = [f | {"column": swap(f["column"])} for f in step["filters"]]
    return out


def replay(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    return reduce(apply, steps, df)


def replay_longest(df: DataFrame, steps: Iterable[Step]) -> tuple[DataFrame, list[Step]]:
    """As many of the steps as can be applied, each in turn, and those that could not."""
    failed = []
    for step in steps:
        try:
            df = apply(df, step)
        except (cleaning.StepError, ValueError, KeyError):
            failed.append(step)
    return df, failed


def refreshed(read: Callable[[], DataFrame], steps: Iterable[Step], held: DataFrame) -> tuple[DataFrame, str | None]:
    """The latest data that ``read`` gives with all steps replayed; if it cannot be read or a step fails, ``held`` as it
    was and why."""
    try:
        return replay(read(), steps), None
    except (cleaning.StepError, OSError, ValueError, KeyError, AnalysisException) as e:
        return held, str(e)


def to_json(steps: Iterable[Step]) -> tuple[str, int]:
    """The steps as a file and how many were left out."""
    steps = list(steps)
    kept = [s for s in steps if s["op"] not in NOT_PORTABLE]
    return json.dumps({"kind": "recipe", "version": 1, "steps": kept}, ensure_ascii=False, indent=1), len(steps) - len(kept)


def from_json(text: str) -> list[Step]:
    found = json.loads(text)
    if found.get("kind") != "recipe":
        raise ValueError("This file holds no steps.")
    return found["steps"]


def needed_columns(steps: Iterable[Step]) -> set[str]:
    """Columns that the steps name and do not make themselves."""
    made: set[str] = set()
    need: set[str] = set()
    for s in steps:
        named = [s.get("column"), *(s.get("columns") or []), s.get("from"), s.get("values") if s["op"] == "widen" else None, s.get("leftKey")]
        need |= {c for c in named if c and c not in made}
        need |= {f["column"] for f in s.get("filters", []) if f["column"] not in made}
        made |= {s[k] for k in ("name", "names", "values") if isinstance(s.get(k), str)}
        if s["op"] == "split":
            made |= {f"{s['column']} {i}" for i in range(1, cleaning.MAX_PARTS + 1)}
    return need


def missing_for(df: DataFrame, steps: Iterable[Step]) -> list[str]:
    """Columns that the steps need and a table does not have."""
    return sorted(needed_columns(steps) - set(df.columns))
