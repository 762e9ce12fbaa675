"""Licence scans against comparing every unit with every template."""

from __future__ import annotations

import re

from gristmill.llm import licenses

from .conftest import odd_rows, plain, prose


def bigrams(text: str) -> set:
    w = re.sub(r"[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).split()
    return set(zip(w, w[1:], strict=False))


def windows(words: list[str]) -> set[str]:
    """As many words as a template has, wherever one of the bigrams of its prefix stands as in the template."""
    out = set()
    for t in licenses.TEMPLATES.values():
        own = re.sub(r"[^a-z0-9]+", " ", t.lower()).split()
        rare = set(licenses.prefix(licenses.template_bigrams(t), 0.8))
        for k in range(len(own) - 1):
            if f"{own[k]} {own[k + 1]}" in rare:
                out |= {" ".join(words[max(i - k, 0) : max(i - k, 0) + len(own)]) for i in range(len(words) - 1) if words[i : i + 2] == own[k : k + 2]}
    return out


def brute(text: str | None) -> tuple:
    low = re.sub(r"[^a-z0-9\n]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    units = {*low.split("\n"), *re.split(r"\n[ \n]*\n", low), low} if text is not None else set()
    units = {" ".join(u.split()) for u in units} | windows(low.split())
    best = []
    for u in units:
        s = bigrams(u)
        scored = [(2 * len(s & o) / (len(s) + len(o)), name) for name, t in licenses.TEMPLATES.items() if (o := bigrams(t)) and s]
        if scored and max(scored)[0] >= 0.8:
            best.append(max(scored))
    top = max(best, default=(0.0, None))
    return top[1], round(top[0], 6), len(best), ",".join(sorted({n for _, n in best}))


def cases() -> list[tuple]:
    texts = []
    for i, t in enumerate(licenses.TEMPLATES.values()):
        words = t.split()
        texts += [t, prose(i, 30) + "\n" + t.upper() + "\n" + prose(i + 50, 30), " ".join(words[: -max(1, len(words) // 8)]), " ".join(words[: len(words) // 2]), t.replace(" ", " \n ", 3) + "\n\n" + prose(i, 9), t + " " + prose(i, 4)]
    texts += ["mit license", "License " * 40, "\n\n\n", "the mit\nlicense released under", "İSC permission to use copy modify"]
    return [(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_query(spark, table):
    rows = odd_rows() + cases()
    found = plain(licenses.op10_licenses(spark, table(rows)))
    assert found == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert sum(r[3] > 0 for r in found) > 60
    assert plain(licenses.op10_licenses(spark, table([]))) == []


def test_notices_within_lines_and_wrapped_ones(spark):
    texts = {
        "MIT": "Copyright (c) 2020 X. Released under the MIT License. All of it.",
        "MIT body": prose(1, 40) + " " + re.sub(r"((?:\S+ ){9})", r"\1\n * ", licenses.TEMPLATES["MIT body"]) + " " + prose(2, 40),
        "Apache-2.0": prose(3, 30) + " It is licensed under the\nApache License,\n\nVersion 2.0. " + prose(4, 30),
        None: prose(5, 60) + " released the under licence of it " + prose(6, 60),
    }
    made = licenses.scan(spark.createDataFrame([(t,) for t in texts.values()], "text string")).collect()
    assert all(name in [m.license for m in r.matches] if name else not r.matches for name, r in zip(texts, made, strict=True))


def test_no_python_in_the_plan(spark, table):
    plan = licenses.op10_licenses(spark, table(cases()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_extra_columns(odd):
    made = licenses.scan(odd)
    assert made.drop("matches").schema == odd.schema and made.where("size(matches) > 0").count() == 1
