"""Quality rules as a short-circuit cascade.

A bounded sample of rows (the first ``SAMPLE_ROWS``) tells each rule's cost (seconds a row) and selectivity (share
rejected). The rule that rejects most a second comes first; the others are then measured anew over the sample's rows
that it let pass, with the parts of a text that it has already read at no cost, and so on. Each rule runs over the rows
that all before it let pass. The order changes the time taken, never the verdict: a row is kept if no rule rejects it.

``report`` states all measures of the base rule for every row, so there the base rule is read first by need, and the
cascade orders what follows it.

Edge cases: null text has no words and fails the base rule; empty tables give no rows and the rules keep the order they
were given; a text of any length is measured whole in its task; repeated rows are judged alike; all other columns pass through, of whatever type and name.
"""

from __future__ import annotations

import copy
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, map_text

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 512

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


class Text:
    """One text, its parts found when first asked for."""

    __slots__ = ("_letters", "_lines", "_repeat", "_words", "raw", "text")

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.raw = self.text.encode()
        self._words = self._lines = self._repeat = self._letters = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    @property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACE)))

    @property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them that are equal to an earlier one."""
        if self._lines is None:
            own = [x for x in self.raw.split(b"\n") if x.strip()]
            self._lines = len(own), len(own) - len(set(own))
        return self._lines

    @property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that are found twice or more."""
        if self._repeat is None:
            words, ids = self.words, {}
            n = len(words)
            if n < 4:
                self._repeat = 0
                return 0
            a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
            v = len(ids)
            if v < 1 << 21:
                key = (a[:-2] * v + a[1:-1]) * v + a[2:]
            else:
                pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)[1]
                key = pair.astype(np.int64) * v + a[2:]
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(n - 2, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            self._repeat = int(covered.sum())
        return self._repeat

    @property
    def letters(self) -> tuple[int, int]:
        """Letters, and capital ones of the Latin-1 range."""
        if self._letters is None:
            self._letters = sum(map(str.isalpha, self.text)), len(_UPPER.findall(self.text))
        return self._letters


def base_fails(t: Text) -> bool:
    n = len(t.words)
    return n < 50 or 100 * t.n_repeat_words > 50 * n


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to be dropped."""

    name: str
    rejects: Callable[[Text], bool]


def _mean_word(t: Text) -> bool:
    n = len(t.words)
    return n > 0 and not 2 * n <= t.word_chars <= 15 * n


def _capitals(t: Text) -> bool:
    letters, upper = t.letters
    return 2 * upper > letters


def _few_letters(t: Text) -> bool:
    return 2 * t.letters[0] < t.word_chars


#: The rules that follow the base rule. Shares are of words, lines or letters of the whole text.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("capitals", _capitals),
    Rule("duplicate_lines", lambda t: 10 * t.lines[1] > 3 * t.lines[0]),
    Rule("few_letters", _few_letters),
    Rule("word_length", _mean_word),
)


def measure(rule: Rule, texts: list[Text]) -> tuple[float, float]:
    """(seconds a row, share rejected) of a rule on texts whose parts stay as they are: it works on copies."""
    texts = [copy.copy(t) for t in texts]
    began = time.perf_counter()
    rejected = sum(map(rule.rejects, texts))
    return (time.perf_counter() - began) / len(texts), rejected / len(texts)


@dataclass(frozen=True)
class Cascade:
    rules: tuple[Rule, ...] = (Rule("base", base_fails), *RULES)

    def ordered(self, docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, given: Callable[[Text], bool] | None = None) -> Cascade:
        """The cascade in order of rejection per cost, each rule measured on what those before it let pass.

        ``take`` reads only as many partitions as it needs, so the sample costs the same for any table. ``given``
        rejects texts before the first rule; the parts that it reads are known to all rules.
        """
        sample = [Text(r[0]) for r in docs.select(F.col(f"`{text}`")).take(rows)]
        left = [t for t in sample if not (given and given(t))]
        waiting, order = list(self.rules), []
        while waiting and left:
            found = {rule.name: measure(rule, left) for rule in waiting}
            best = max(waiting, key=lambda r: found[r.name][1] / max(found[r.name][0], 1e-9))  # the first of equals
            if not found[best.name][1]:  # none rejects anything more: the cheapest first
                return Cascade((*order, *sorted(waiting, key=lambda r: found[r.name][0])))
            order.append(best)
            waiting.remove(best)
            left = [t for t in left if not best.rejects(t)]
        return Cascade((*order, *waiting))

    def keeps(self, text: Text) -> bool:
        """Rule by rule, up to the first that rejects."""
        return not any(rule.rejects(text) for rule in self.rules)

    def apply(self, docs: DataFrame, text: str = "text", flag: str = "kept") -> DataFrame:
        """``docs`` with a boolean column ``flag``; a column of that name is replaced."""
        return map_text(docs, text, lambda texts: {flag: [self.keeps(Text(t)) for t in texts]}, {flag: "boolean"})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, as they are."""
    flag = fresh(docs, "quality_kept")
    return Cascade().ordered(docs).apply(docs, flag=flag).where(F.col(flag)).drop(flag)


OUT = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean",
}


def report(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures in ``OUT`` in place of the text; the cascade judges what the base rule lets pass."""
    cascade = Cascade(rules).ordered(docs, text, given=base_fails)

    def measured(t: Text) -> tuple[int | bool, ...]:
        failed = base_fails(t)
        return len(t.words), t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words, failed, not failed and cascade.keeps(t)

    def work(texts: list[str | None]) -> dict[str, Any]:
        rows = [measured(Text(t)) for t in texts]  # the parts of one text at a time
        return {n: [r[i] for r in rows] for i, n in enumerate(OUT)}

    return map_text(docs, text, work, OUT, drop=[text])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM d),
f AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(length(text) - length(regexp_replace(text, '\pL', '', 'g')) AS BIGINT) AS letters,
    CAST(length(text) - length(regexp_replace(text, '[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]', '', 'g')) AS BIGINT) AS upper_letters
  FROM p),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
s AS (
  SELECT f.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM f LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * upper_letters <= letters AND 10 * n_dup_lines <= 3 * len(lines)
    AND 2 * letters >= word_chars AND word_chars BETWEEN 2 * n_words AND 15 * n_words AS kept
FROM b
"""
