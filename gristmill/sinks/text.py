"""Tables as delimited text that spreadsheets can open without running it, and recipes as scripts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import RAW, parse_number, text_of
from ..operators.sorting import ROW


def guarded(text: Column) -> Column:
    """A text that a spreadsheet would take for a formula gets an apostrophe; numbers such as -5 stay."""
    return F.when(text.rlike(r"^[=+\-@\t\r]") & parse_number(text).isNull(), F.concat(F.lit("'"), text)).otherwise(text)


def cells(df: DataFrame) -> DataFrame:
    """Every column as the text it was read from, or its value as text; missing ones empty."""
    names = [c for c in df.columns if c not in (RAW, ROW)]
    return df.select(*[F.coalesce(guarded(text_of(df, c)), F.lit("")).alias(c) for c in names])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """One part a partition, each with a header; quotes only where needed."""
    cells(df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def script(steps: Iterable[dict], table: str = "table.csv") -> str:
    """A Python script that loads a table and replays the steps; steps that hold another table are left out."""
    from ..plans.recipe import NOT_PORTABLE

    kept = [s for s in steps if s["op"] not in NOT_PORTABLE]
    lines = [
        "from pyspark.sql import SparkSession", "", "from gristmill.plans.recipe import replay", "from gristmill.sources.text import load", "",
        "spark = SparkSession.builder.getOrCreate()", f"df = load(spark, {table!r})", "steps = [", *[f"    {s!r}," for s in kept], "]", "df = replay(df, steps)", "df.show()",
    ]
    return "\n".join(lines) + "\n"


def pivot_text(wide: DataFrame, rows: str, columns: str) -> list[list[str]]:
    """A pivot (a few rows) as cells with its header and totals."""
    header = [f"{rows} \\ {columns}", *wide.columns[1:]]
    body = [["" if v is None else str(v) for v in r] for r in wide.collect()]
    return [header, *sorted(body, key=lambda r: (r[0] == "Total", r[0]))]
