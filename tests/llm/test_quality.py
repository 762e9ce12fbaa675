"""Quality cascade against a plain reading of its rules."""

from __future__ import annotations

import re
from collections import Counter

from gristmill.llm import quality

from .conftest import odd_rows, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    symbols, chars = sum(c in "#*$%&|<>" for c in t), sum(map(len, words))
    letters = sum(c.isalpha() for c in t)
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
    repeats = len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    good = 10 * symbols <= len(words) and 2 * upper <= letters and 10 * repeats <= 3 * len(lines) and 2 * letters >= chars and 2 * len(words) <= chars <= 15 * len(words)
    return len(words), chars, symbols, repeats, len(covered), failed, bool(not failed and good)


def test_query_equals_plain_reading(spark, table):
    found = plain(quality.op1_quality(spark, table(odd_rows())))
    assert found == sorted(((r[0], *brute(r[1])) for r in odd_rows()), key=repr)


def test_order_changes_nothing_and_rows_pass_through(odd):
    rules = quality.Cascade().rules
    kept = [plain(quality.Cascade(order).apply(odd, flag="ok").select("doc_id", "text", "ok", "id", "first", "piece", "wide", "node")) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1]
    good = quality.keep_good(odd)
    assert good.schema == odd.schema
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in odd.collect() if brute(r.text)[-1]}
    wanted = [r for r in odd.collect() if brute(r.text)[-1]]
    assert sorted(map(repr, good.collect())) == sorted(map(repr, wanted))


def test_most_rejecting_rule_first(spark, odd):
    none, every = quality.Rule("none", lambda t: False), quality.Rule("all", lambda t: True)
    assert [r.name for r in quality.Cascade((none, every)).ordered(odd).rules] == ["all", "none"]
    assert quality.Cascade((none, every)).apply(odd).where("kept").count() == 0


def test_flag_replaces_clashing_column_and_empty_table(odd, empty):
    assert dict(quality.Cascade().apply(odd).dtypes)["kept"] == "boolean"
    assert quality.keep_good(empty).count() == 0 and quality.Cascade().ordered(empty).rules == quality.Cascade().rules


def test_wide_vocabulary_windows():
    text = " ".join(f"w{i}" for i in range(3000)) + " w5 w6 w7"
    assert quality.Text(text).n_repeat_words == brute(text)[4] == 6
