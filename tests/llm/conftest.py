"""Small tables with every odd case, written as Parquet where queries read tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names are those that operators use inside, and whose types Python could spoil.
EXTRA = "node long, kept string, row string, id decimal(38,5), first timestamp, mix_size string, piece map<string,int>, wide array<int>, g long"
SYLLABLES = "an ber che do en fi ga hel in ka lo mer no or pa que ri sta tion un ver wi xo yl za".split()


def prose(seed: int, words: int, end: str = ".") -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(words)) + end


def edited(text: str, changes: int, seed: int) -> str:
    rnd, words = random.Random(seed), text.split(" ")
    for i in rnd.sample(range(len(words)), changes):
        words[i] = f"changed{rnd.randint(0, 10**6)}"
    return " ".join(words)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, odd characters."""
    base = prose(1, 120)
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one", "two words", base, base, edited(base, 2, 5), edited(base, 30, 6),
        prose(2, 40), prose(3, 200) + "\n" + prose(4, 90), prose(5, 6000), "same line here\n" * 60, "# $ % & | < > * " * 40,
        "LOUD WORDS " * 60, "Ünïcode   nbsp   line 😀 é İ K ½ ² " + prose(6, 60), "x" * 5000, "a" * 900,
        "mail me at jo.doe+x@mail.example.org or 10.0.0.255, card 4539 1488 0343 6467, call +49 (30) 1234-5678.",
        "Released under the MIT License.\n\n" + prose(7, 80), prose(7, 80), prose(8, 500, ""),
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "c")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None), (None, None, None, None, None), (7, base, "en", "a", 3), (2**62 + 1, base, "en", "z", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns."""
    import datetime as dt
    import decimal

    more = [(2**60 + i if i % 2 else None, "k", None if i % 3 else "r", decimal.Decimal(i) if i % 5 else None, dt.datetime(2024, 1, 1 + i % 28), None, {"a": i} if i % 2 else None, [i, None], i) for i in range(len(odd_rows()))]
    return spark.createDataFrame([r + m for r, m in zip(odd_rows(), more, strict=True)], f"{SCHEMA}, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {EXTRA}")


@pytest.fixture
def table(spark, tmp_path):
    """Writes a table and gives the folder that queries take."""

    def write(rows, schema: str = SCHEMA, name: str = "documents", parts: int = 3) -> str:
        df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
        df.repartition(parts).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def plain(df) -> list[tuple]:
    """Rows in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_columns(a: T.StructType, b: T.StructType) -> bool:
    return [(f.name, f.dataType) for f in a.fields] == [(f.name, f.dataType) for f in b.fields]
