"""Values as people read them (driver-side, for short results)."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, functions as F

#: Symbols that stand before or behind numbers of one unit.
BEFORE, BEHIND = "$€£¥", "%"


def number(x: float | None) -> str:
    """Thousands separated; one decimal from 100 on, two from 1 on, four below; powers of ten beyond 1e-4 and 1e15."""
    if x is None or not math.isfinite(x):
        return ""
    size = abs(x)
    if size and (size < 1e-4 or size >= 1e15):
        return f"{x:.3e}"
    text = f"{x:,.{1 if size >= 100 else 2 if size >= 1 else 4}f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def date(at: dt.datetime | None) -> str:
    """Mar 5, 2024, with the time if there is one."""
    if at is None:
        return ""
    day = f"{at:%b} {at.day}, {at.year}"
    return day if (at.hour, at.minute, at.second) == (0, 0, 0) else f"{day} {at:%H:%M}"


def value(x: object) -> str:
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, dt.datetime):
        return date(x)
    return number(float(x)) if isinstance(x, int | float) else "" if x is None else str(x)


def share(x: float) -> str:
    return f"{math.floor(100 * x + 0.5)}%"


def unit_symbol(text: Column) -> Column:
    """The currency before or the percent sign behind a number's text."""
    head = F.regexp_extract(F.trim(text), rf"^[-+(]?([{BEFORE}])", 1)
    tail = F.regexp_extract(F.trim(text), r"([$€£¥%])\)?$", 1)
    return F.when(head != "", head).when(tail != "", tail)


def excel_day(serial: Column) -> Column:
    """The time that a workbook's serial number of a day stands for."""
    return F.timestamp_millis(F.round((serial.cast("double") - 25569) * 86_400_000).cast("long"))
