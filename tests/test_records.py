"""Records cut by many tasks: equal to plain readers wherever the ranges end."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest

from gristmill.sources import records as rec, text as source


@pytest.fixture
def small_ranges(spark):
    """Files are split every few bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "8"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ordered(spark, path, scanner) -> list[str]:
    return [r.record for r in rec.records(spark, path, scanner).orderBy("file", "begin", "n").collect()]


def test_random_delimited_text(spark, tmp_path, small_ranges):
    rnd = random.Random(3)
    pieces = ["a", "b c", ",", '"', ";", "\n", "\r\n", "é", "1.5", "x,y", " lead", "tail ", '""', "\n\n", "long word " * 9]
    for case in range(4):
        rows = [["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 4))) for _ in range(3)] for _ in range(25)]
        out = io.StringIO()
        end = rnd.choice(["\n", "\r\n"])
        writer = csv.writer(out, lineterminator=end, quoting=rnd.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]))
        writer.writerow(["h1", "h2\nmore", "h3"])
        for r in rows:
            writer.writerow(r)
            if rnd.random() < 0.1:
                out.write(end)
        path = tmp_path / f"f{case}.csv"
        path.write_bytes(out.getvalue().encode("utf-8"))
        cut = ordered(spark, str(path), rec.Delimited(",", "UTF-8"))
        assert [next(csv.reader(io.StringIO(r, newline=""))) for r in cut] == [["h1", "h2\nmore", "h3"], *rows]
        found = source.read_delimited(spark, str(path), ",")
        assert found.columns == ["h1", "h2\nmore", "h3"] and found.rdd.getNumPartitions() > 8
        assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in rows)


def test_ranges_are_read_once_a_use(spark, tmp_path, small_ranges):
    """One pass for the states, one for the parts of records that cross ranges, then one for each use of the table."""
    (tmp_path / "f.csv").write_text("k,v\n" + "".join(f'{i},"line\nof {i}"\n' for i in range(100)))
    effects, cuts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counted(rec.Delimited):
        def effect(self, pieces, first):
            effects.add(1)
            return super().effect(pieces, first)

        def cut(self, pieces, state, first):
            cuts.add(1)
            return super().cut(pieces, state, first)

    found = rec.records(spark, str(tmp_path / "f.csv"), Counted(",", "UTF-8"))
    ranges = effects.value
    assert ranges == found.select("begin").distinct().count() > 8
    before = cuts.value
    assert before == 2 * ranges and len(found.collect()) == 101 and cuts.value - before == ranges


@pytest.mark.parametrize("cell", ["x", "word " * 40])
def test_the_widest_record_has_a_line_end(spark, tmp_path, small_ranges, cell):
    """Fields are counted in records, within a range or across ranges, not in lines."""
    (tmp_path / "w.csv").write_text("k,v\n" + 'a,"b\nc"\n' * 20 + f'1,2,"{cell}\n,{cell}",4\n' + 'a,"b\nc"\n' * 20)
    found = source.read_delimited(spark, str(tmp_path / "w.csv"))
    assert found.columns == ["k", "v", "Column 3", "Column 4"]
    assert tuple(found.where("`Column 4` = '4'").first()) == ("1", "2", f"{cell}\n,{cell}", "4") and found.count() == 41


@pytest.mark.parametrize("lines", [1, 2, 5])
def test_chunks_of_lines(monkeypatch, lines):
    """Records and parts do not hang on how many lines are looked at at once."""
    rnd = random.Random(8)
    for _ in range(300):
        text = ["".join(rnd.choice(['"', '"', ",", "a", '""', "\r", " "]) for _ in range(rnd.randint(0, 8))).encode() for _ in range(6)]
        one, state = rec.Delimited(",", "UTF-8"), rnd.random() < 0.5
        monkeypatch.setattr(rec, "LINES", 1000)
        whole = list(one.cut(text, state, False)), one.effect(text, False)
        monkeypatch.setattr(rec, "LINES", lines)
        assert (list(one.cut(text, state, False)), one.effect(text, False)) == whole


def test_ends_of_files(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_text('a,b\n1,"two\nthree' + " and on" * 40 + "\n4,5")
    found = source.read_delimited(spark, str(tmp_path / "open.csv"))
    assert [tuple(r) for r in found.collect()] == [("1", "two\nthree" + " and on" * 40 + "\n4,5")]
    (tmp_path / "old.csv").write_bytes(b'\xef\xbb\xbf"a",b\r1,"x\ry"\r\r2,z\r')
    assert [tuple(r) for r in source.read_delimited(spark, str(tmp_path / "old.csv")).collect()] == [("1", "x\ry"), ("2", "z")]
    (tmp_path / "w.csv").write_bytes('a;b\n"café €\nx";2\n'.encode("cp1252") * 1 + ('"“y”";3\n' * 30).encode("cp1252"))
    rows = source.read_delimited(spark, str(tmp_path / "w.csv")).collect()
    assert len(rows) == 31 and tuple(rows[0]) == ("café €\nx", "2") and tuple(rows[7]) == ("“y”", "3")


def test_folder_of_files(spark, tmp_path, small_ranges):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"p{i}.csv").write_text("k,v\n" + "".join(f'{i}-{j},"line\nof {j}"\n' for j in range(8 * i)))
    found = source.read_delimited(spark, str(tmp_path / "in"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"{i}-{j}", f"line\nof {j}") for i in range(5) for j in range(8 * i))


def test_random_json(spark, tmp_path, small_ranges):
    rnd = random.Random(4)
    words = ["a", "}", "{", "[", "]", '"', "\\", ",", "é", "\n", "x" * 30, '\\"', "},{"]

    def value(depth=0):
        k = rnd.random()
        if k < 0.5 or depth > 2:
            return "".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))
        if k < 0.7:
            return rnd.choice([1, 2.5, None, True, -7])
        if k < 0.85:
            return [value(depth + 1) for _ in range(rnd.randint(0, 3))]
        return {rnd.choice("pqr") + str(i): value(depth + 1) for i in range(rnd.randint(0, 3))}

    for case in range(6):
        items = [{"id": str(i), "v": value(), "w": value()} for i in range(rnd.choice((1, 20)))]
        data = items if case % 2 else {"m": "[", "r": items, "later": [{"id": "no"}, [1]], "z": "]"}
        text = json.dumps(data, indent=rnd.choice((None, 1)), ensure_ascii=rnd.random() < 0.5)
        path = tmp_path / f"f{case}.json"
        path.write_text(text, encoding="utf-8")
        cut = ordered(spark, str(path), rec.Elements())
        assert [json.loads(r) for r in cut] == items
        found = source.read_json(spark, str(path))
        assert found.columns == ["id", "v", "w"] and sorted(r.id for r in found.collect()) == sorted(x["id"] for x in items)


def test_no_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="array"):
        source.read_json(spark, str(tmp_path / "a.json"))
    (tmp_path / "d.json").write_text(json.dumps({"meta": {"note": "[not this", "k": {"inner": [1, 2]}}, "rows": [{"a": 1}], "later": [{"a": 2}]}))
    assert [tuple(r) for r in source.read_json(spark, str(tmp_path / "d.json")).collect()] == [("1",)]
    (tmp_path / "b.json").write_text("[]")
    assert source.read_json(spark, str(tmp_path / "b.json")).count() == 0
    (tmp_path / "c.json").write_text('[{"a": 1}, null, 5, {"b": "x"}]')
    assert [tuple(r) for r in source.read_json(spark, str(tmp_path / "c.json")).collect()] == [("1", ""), ("", ""), ("", ""), ("", "x")]


def test_effects_compose():
    """The map of a text is the composition of the maps of its parts, wherever it is cut."""
    rnd = random.Random(5)
    one = rec.Delimited(",", "UTF-8")
    for _ in range(300):
        lines = ["".join(rnd.choice(['"', ",", "a", '""', "\r"]) for _ in range(rnd.randint(0, 8))).encode() for _ in range(6)]
        for k in range(7):
            first, second, both = one.effect(lines[:k], False), one.effect(lines[k:], False), one.effect(lines, False)
            assert [second[int(x)] for x in first] == both
