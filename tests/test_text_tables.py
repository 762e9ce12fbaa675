"""Text and JSON tables, exports and streams."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions.values import RAW, kind_of, parse_date, parse_number
from gristmill.sinks import text as sink
from gristmill.sources import text as source
from gristmill.streaming import live


def test_encodings():
    assert source.encoding_of("é".encode("utf-8")[:1] + b"") == "UTF-8" and source.encoding_of("é".encode("cp1252") + b" x") == "windows-1252"
    assert source.encoding_of("﻿a".encode("utf-16-le")) == "UTF-16LE" and source.encoding_of("﻿a".encode("utf-8")) == "UTF-8"


def test_delimiters_and_headers():
    assert source.delimiter_of("a;b\n1,5;2\n2,5;3\n") == ";" and source.delimiter_of('a,b\n"x;y;z",1\n') == "," and source.delimiter_of("a\tb\n1\t2") == "\t" and source.delimiter_of("one\ntwo") == ","
    assert source.unique_headers(["x", "x", "", None, "x (2)"]) == ["x", "x (2)", "Column 3", "Column 4", "x (2) (2)"]


def test_kinds_and_values(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text('day,amount,ok,code,note,when\n2024-01-05,"1,234.50",yes,007,"He said ""hi""\nand left",31/12/2023\n2024-01-06,$20,no,008,plain,1/2/2024\nn/a,(5),Y,009,,2/2/2024\n', encoding="utf-8")
    df = source.load(spark, str(path))
    assert {c: kind_of(df, c) for c in df.columns if c != RAW} == {"day": "date", "amount": "number", "ok": "boolean", "code": "category", "note": "category", "when": "date"}
    rows = df.collect()
    assert [r.amount for r in rows] == [1234.5, 20.0, -5.0] and [r.ok for r in rows] == [True, False, True] and rows[0].note == 'He said "hi"\nand left'
    assert [str(r.when)[:10] for r in rows] == ["2023-12-31", "2024-02-01", "2024-02-02"] and rows[2].day is None and rows[0][RAW].amount == "1,234.50"


def test_decimal_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Artikel;Preis\nTee;1.234,5\nKaffee;2,25\n", encoding="cp1252")
    df = source.load(spark, str(tmp_path / "a.csv"))
    assert [r.Preis for r in df.collect()] == [1234.5, 2.25]


@pytest.mark.parametrize(
    ("text", "number"),
    [("1,234", 1234), ("1,23", None), ("12%", 12), ("€ 5", 5), ("-3.5e2", -350), ("(1,000)", -1000), ("(-5)", None), ("1 000", None), ("", None), (".5", 0.5), ("5.", None), ("+7", 7), ("1e400", None), ("abc", None)],
)
def test_numbers(spark, text, number):
    assert spark.range(1).select(parse_number(F.lit(text))).first()[0] == number


@pytest.mark.parametrize(
    ("text", "day"),
    [("2024-3-5", "2024-03-05 00:00:00"), ("2024/03/05", "2024-03-05 00:00:00"), ("5.3.2024", "2024-05-03 00:00:00"), ("13/2/2024", "2024-02-13 00:00:00"), ("Mar 5, 2024", "2024-03-05 00:00:00"),
     ("5 March 2024", "2024-03-05 00:00:00"), ("2024-03-05T10:20", "2024-03-05 10:20:00"), ("2024-03-05 10:20:30+0200", "2024-03-05 08:20:30"), ("2023-02-31", None), ("Foo 5, 2024", None), ("20240305", None)],
)
def test_dates(spark, text, day):
    found = spark.range(1).select(parse_date(F.lit(text)).cast("string")).first()[0]
    assert found == day


def test_random_tables_against_a_plain_reader(spark, tmp_path):
    rnd = random.Random(9)
    pieces = ["a", "b c", ",", '"', ";", "\n", "é", "1.5", "x,y", " lead", "tail "]
    for case in range(6):
        rows = [["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 3))) for _ in range(3)] for _ in range(12)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["h1", "h2", "h3"], *rows])
        path = tmp_path / f"f{case}.csv"
        path.write_text(out.getvalue(), encoding="utf-8")
        assert [list(r) for r in source.read_delimited(spark, str(path), ",").collect()] == rows


def test_rows_beyond_the_head(spark, tmp_path):
    """Quoted line ends, wider rows and other bytes count wherever they stand."""
    many = "".join(f"{i},plain\n" for i in range(40_000))
    (tmp_path / "a.csv").write_text("n,s\n" + many + '40000,"two\nlines, ""quoted"""\n40001,x,extra\n', encoding="utf-8")
    df = source.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["n", "s", "Column 3"] and df.count() == 40_002
    assert [tuple(r) for r in df.where("n >= 40000").orderBy("n").collect()] == [("40000", 'two\nlines, "quoted"', None), ("40001", "x", "extra")]
    (tmp_path / "b.csv").write_bytes(("n,s\n" + many).encode() + "40000,caf\u00e9 \u20ac\n".encode("cp1252"))
    assert source.read_delimited(spark, str(tmp_path / "b.csv")).where("n = '40000'").first().s == "caf\u00e9 \u20ac"
    (tmp_path / "c.csv").write_text("n;s\n" + many.replace(",", ";") + "1;5\" pipe;3;4\n", encoding="utf-8")
    assert source.read_delimited(spark, str(tmp_path / "c.csv")).columns == ["n", "s", "Column 3", "Column 4"]


def test_decimal_commas_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y;z\n1,5;1.100;1.5\n2,25;12.300;2.5\n", encoding="utf-8")
    assert [tuple(r)[:3] for r in source.load(spark, str(tmp_path / "a.csv")).collect()] == [(1.5, 1100.0, 1.5), (2.25, 12300.0, 2.5)]


def test_kinds_after_stacking_and_joining(spark, tmp_path):
    from gristmill.operators import cleaning, combine

    (tmp_path / "a.csv").write_text("id,v,code\n1,10,1\n2,20,2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,v,code\n3,many,3\n4,few,4\n", encoding="utf-8")
    a, b = (source.load(spark, str(tmp_path / f"{n}.csv")) for n in "ab")
    made = combine.append(cleaning.set_kind(a, "code", "category"), b)
    assert {c: kind_of(made, c) for c in ("id", "v", "code")} == {"id": "number", "v": "category", "code": "category"}
    assert [tuple(r)[:3] for r in made.orderBy("id").collect()] == [(1.0, "10", "1"), (2.0, "20", "2"), (3.0, "many", "3"), (4.0, "few", "4")]
    joined = combine.join(a, b.drop("code"), "id", "id", "full")
    assert joined.columns[:4] == ["id", "v", "code", "v (other)"] and joined.count() == 4 and kind_of(joined, "id") == "number"


def test_json_forms(spark, tmp_path):
    objects = [{"b": 2.0, "a": "x"}, {"a": None, "c": {"k": [1, 2]}, "b": 1.5}]
    forms = {"array.json": json.dumps(objects), "inner.json": json.dumps({"meta": 1, "rows": objects}), "lines.jsonl": source.to_lines(objects)}
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        df = source.read_json(spark, str(tmp_path / name))
        assert df.columns == ["b", "a", "c"], name
        assert [tuple(r) for r in df.collect()] == [("2", "x", ""), ("1.5", "", '{"k":[1,2]}')], name


def test_stacked_files(spark, tmp_path):
    for name, text in (("one.csv", "id,Amount\n1,2\n"), ("two.csv", "amount, ID\n5,6\n"), ("other.csv", "x\n1\n")):
        (tmp_path / name).write_text(text)
    df = source.load_stacked(spark, [str(tmp_path / n) for n in ("one.csv", "two.csv", "other.csv")])
    assert sorted((r.id, r.Amount, r.source) for r in df.collect()) == [(1.0, 2.0, "one.csv"), (6.0, 5.0, "two.csv")]


def test_links():
    assert source.download_link("https://docs.google.com/spreadsheets/d/abc-1/edit#gid=7") == "https://docs.google.com/spreadsheets/d/abc-1/export?format=csv&gid=7"
    assert source.download_link("https://github.com/o/r/blob/main/a/b.csv") == "https://raw.githubusercontent.com/o/r/main/a/b.csv"
    with pytest.raises(ValueError, match="http"):
        source.download_link("file:///etc/passwd")


def test_data_behind_an_address(spark, tmp_path):
    import functools
    import http.server
    import threading

    from gristmill.plans import recipe

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    (tmp_path / "sales.csv").write_text("id,v\n1,2.5\n2,4\n")
    (tmp_path / "page.csv").write_text("<!DOCTYPE html><html></html>")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert [tuple(r)[:2] for r in source.load(spark, source.fetched(spark, f"{base}/sales.csv")).collect()] == [(1.0, 2.5), (2.0, 4.0)]
        with pytest.raises(ValueError, match="web page"):
            source.fetched(spark, f"{base}/page.csv")
        old = spark.range(1)
        latest = lambda: source.load(spark, source.fetched(spark, f"{base}/sales.csv"))
        fresh, why = recipe.refreshed(latest, [{"op": "rename", "column": "v", "name": "w"}], old)
        assert fresh.columns[:2] == ["id", "w"] and why is None
        kept, why = recipe.refreshed(latest, [{"op": "rename", "column": "gone", "name": "w"}], old)
        assert kept is old and "gone" in why
        assert recipe.refreshed(lambda: source.load(spark, source.fetched(spark, f"{base}/none.csv")), [], old)[0] is old
    finally:
        server.shutdown()
    assert source.link_name("https://a.org/x/my%20data.csv?x=1") == "my data.csv" and source.link_name("https://a.org") == "a.org.csv"


def test_form_answers(spark):
    fields = [{"id": "r", "label": "Rating", "type": "rating"}, {"id": "c", "label": "Drinks", "type": "checkboxes", "options": ["tea", "milk"]}, {"id": "y", "label": "Member", "type": "yesno"}, {"id": "t", "label": "Note", "type": "paragraph"}]
    one = spark.createDataFrame([("1", 1, "2024-01-02", '{"r": 4, "c": ["tea"], "y": "yes", "t": "fine"}'), ("2", 2, "2024-01-03", "{}")], "id string, received int, submitted string, values string")
    both = source.merged_responses([one, one.withColumn("received", F.lit(9))])
    df = source.responses(both, fields).orderBy("Submitted")
    assert df.columns == ["Submitted", "Rating", "Drinks", "Drinks: tea", "Drinks: milk", "Member", "Note"]
    assert [tuple(r)[1:] for r in df.collect()] == [(4.0, "tea", True, False, True, "fine"), (None, None, None, None, None, None)]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5.0, True), ("-", None, None), ('a "b",c', 0.5, False), ("-5", 1e6, True)], "s string, v double, f boolean")
    sink.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert list(csv.reader(io.StringIO(text))) == [["s", "v", "f"], ["'=1+1", "-5", "yes"], ["'-", "", ""], ['a "b",c', "0.5", "no"], ["-5", "1000000", "yes"]]
    assert "replay" in sink.script([{"op": "delete", "column": "a"}, {"op": "join"}]) and "join" not in sink.script([{"op": "join"}])


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00", "ab"[i % 2]) for i in range(12)] + [(3, "2024-01-01 10:00:00", "b")], "id int, t string, kind string").withColumn("t", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    live.write_available(live.first_answers(stream(), "id", "t"), str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 12
    query = live.live_groups(stream(), "kind", "t").writeStream.outputMode("complete").format("memory").queryName("groups").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sum(r.n for r in spark.table("groups").collect()) == 13 and spark.table("groups").count() == 6
