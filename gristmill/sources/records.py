"""Records of large text files, cut by many tasks.

Where a record ends depends on all that stands before it: a line end within quotes ends nothing, a comma within an inner object
separates nothing. So a file is read in ranges, as Spark splits it. A first pass finds for each range what it makes of
every state that it may begin in; these maps are composed in the order of the ranges (a row for each range, one for about 128 MB of
input). Then each range knows its state and cuts its records. What stands before a range's first cut or after its last one
is a part of a record that crosses ranges; those few parts are put together by a grouping.

A range is streamed piece by piece, so a task holds one record at a time. Only a record itself is whole in a task.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ..operators.storage import saved

#: Parts of a record: all of it, its end, its beginning, or a range that lies within it.
WHOLE, END, BEGIN, MIDDLE = range(4)
#: A row that has the most fields of a range's whole records as its number.
WIDEST = 4
#: Lines of delimited text that are looked at at once.
LINES = 2048
#: A range within its file: file, begin (byte).
Range = tuple[str, int]


class Scanner(Protocol):
    """How a kind of file is cut. States and effects are plain values that the driver can hold."""

    separator: str

    def effect(self, pieces: Iterable[bytes], first: bool) -> list[int]:
        """What a range makes of each state it may begin in, as numbers."""

    def states(self, effects: list[list[int]]) -> list[Any]:
        """The state at the begin of each range of a file, from the effects in order, and that at the file's end."""

    def cut(self, pieces: Iterable[bytes], state: Any, first: bool) -> Iterator[tuple[int, str]]:
        """The records of a range and the parts at its ends."""


class Delimited:
    """Delimited text: quotes may hold delimiters and line ends, and count at the start of a field only. The state says whether
    a range begins within quotes.

    Lines are looked at in chunks of ``LINES``, each with a few patterns, and not one by one. A chunk ends with a line, so what
    is left of it begins a record that is open.
    """

    separator = "\n"

    def __init__(self, delimiter: str, encoding: str):
        d, self.delimiter = re.escape(delimiter), delimiter
        self.encoding = "cp1252" if encoding == "windows-1252" else encoding
        starts = rf"(?<![^{d}\r\n])" if len(delimiter) == 1 else rf"(?:(?<![^\r\n])|(?<={d}))"
        closed = r'"[^"]*+(?:""[^"]*+)*+"'
        self.closing = re.compile(closed[1:])
        self.closed = re.compile(starts + closed)
        self.opening = re.compile(starts + '"')
        # a record with its line end, or all that stands behind the start of one that is open
        self.record = re.compile(rf'(?:[^"\r\n]++|{starts}{closed}|(?!{starts})")*+(?:\r\n|\r|\n|"[\s\S]*)')

    def after(self, text: str, is_open: bool) -> bool:
        """Whether quotes are open behind lines."""
        if '"' not in text:
            return is_open
        if is_open:
            if not (m := self.closing.match(text)):
                return True
            text = "-" + text[m.end() :]
        return bool(self.opening.search(self.closed.sub("-", text)))

    def chunks(self, pieces: Iterable[bytes], first: bool) -> Iterator[str]:
        """Lines with their ends, many at once."""
        for i, held in enumerate(itertools.batched(pieces, LINES)):
            text = b"\n".join(held).decode(self.encoding, "replace") + "\n"
            yield text.removeprefix("\ufeff") if first and not i else text

    def effect(self, pieces: Iterable[bytes], first: bool) -> list[int]:
        closed, opened = False, True
        for text in self.chunks(pieces, first):
            same = closed == opened
            closed = self.after(text, closed)
            opened = closed if same else self.after(text, opened)
        return [closed, opened]

    def width(self, record: str) -> int:
        """Number of fields of a whole record."""
        return (self.closed.sub("-", record) if '"' in record else record).count(self.delimiter) + 1

    def states(self, effects: list[list[int]]) -> list[bool]:
        found, now = [], False
        for made in effects:
            found.append(now)
            now = bool(made[now])
        return [*found, now]

    def cut(self, pieces: Iterable[bytes], state: bool, first: bool) -> Iterator[tuple[int, str]]:
        """Blank lines between records are left out, and the line ends behind them; a carriage return alone ends a line too."""
        held, now, inside = [], state, state
        for text in self.chunks(pieces, first):
            at = 0
            if now:
                m = self.closing.match(text)
                end = m and self.record.match(text, m.end())
                if not end or self.after(end[0], False):
                    held.append(text)
                    continue
                held.append(text[: end.end()])
                yield END if inside else WHOLE, "".join(held).removesuffix("\n").removesuffix("\r")
                held, inside, at = [], False, end.end()
            found = self.record.findall(text, at)
            now = bool(found) and self.after(found[-1], False)
            if now:
                held.append(found.pop())
            for line in found:
                if line := line.removesuffix("\n").removesuffix("\r"):
                    if not line.isspace():
                        yield WHOLE, line
        if held:
            yield MIDDLE if inside else BEGIN, "".join(held)


class Elements:
    """The elements of a JSON array, or of the first array in an object. The state is None before the array and after it, else
    whether a range begins within a string, and its depth within the array (1 between elements)."""

    separator = "}"
    _TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{},"]', re.S)
    _REST = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
    _ESCAPE = re.compile(r"\\.", re.S)
    _OTHER = re.compile(r"[^\[\]{}]++")

    def texts(self, pieces: Iterable[bytes]) -> Iterator[str]:
        for piece in pieces:
            yield piece.decode("utf-8", "replace") + "}"

    def effect(self, pieces: Iterable[bytes], first: bool) -> list[int]:
        """For a begin out of and within a string: within one at the end, change of depth, least depth on the way; and, for
        the first range of a file, the depth within its array at its end (-1 if the array ends, -2 if it does not begin)."""
        within, change, least = [0, 1], [0, 0], [0, 0]
        depth, base, quoted = 0, None, False
        for text in self.texts(pieces):
            parts = self._ESCAPE.sub("", text).split('"')
            for start in (0, 1):
                # every other part between quotes is out of strings, which ones depends on the state
                marks = self._OTHER.sub("", "".join(parts[within[start] :: 2]))
                for m in marks:
                    change[start] += 1 if m in "[{" else -1
                    least[start] = min(least[start], change[start])
                within[start] = (within[start] + len(parts) - 1) % 2
            if first and base != -1:
                for m in self._OTHER.sub("", "".join(parts[quoted::2])):
                    if base is None and m == "[" and depth <= 1:
                        base = depth
                    depth += 1 if m in "[{" else -1
                    if base is not None and depth <= base:
                        base = -1
                        break
                quoted = (quoted + len(parts) - 1) % 2 == 1
        inner = -2 if base is None else -1 if base == -1 else depth - base
        return [*within, *change, *least, inner]

    def states(self, effects: list[list[int]]) -> list[Any]:
        inner = effects[0][6]
        if inner == -2:
            raise ValueError("A JSON file must be an array of objects, or an object with an array near its begin.")
        found: list[Any] = ["first"]
        now = (bool(effects[0][0]), inner) if inner >= 0 else None
        for made in effects[1:]:
            found.append(now)
            if now is not None:
                s = int(now[0])
                depth = now[1]
                now = (bool(made[s]), depth + made[2 + s]) if depth + made[4 + s] > 0 else None
        return [*found, now]

    def cut(self, pieces: Iterable[bytes], state: Any, first: bool) -> Iterator[tuple[int, str]]:
        """Elements as JSON texts; what begins at a range's end may be blank."""
        if state is None:
            return
        held: list[str] = []
        begun = state != "first"
        inside, ended = begun, False
        quoted, depth = state if begun else (False, 0)
        for text in self.texts(pieces):
            if ended:
                break
            at = start = 0
            if quoted:
                m = self._REST.match(text)
                if not m:
                    if begun:
                        held.append(text)
                    continue
                at, quoted = m.end(), False
            for m in self._TOKEN.finditer(text, at):
                t = m[0]
                if t == '"':  # a string that goes on beyond the piece
                    quoted = True
                    break
                if t in "[{":
                    if not begun and t == "[" and depth <= 1:
                        begun, depth, start = True, 0, m.end()
                    depth += 1
                elif t in "]}":
                    depth -= 1
                    ended = begun and depth == 0
                if begun and (ended or t == "," and depth == 1):
                    held.append(text[start : m.start()])
                    record = "".join(held)
                    if inside or record.strip():
                        yield END if inside else WHOLE, record
                    held, inside, start = [], False, m.end()
                if ended:
                    break
            if begun and not ended:
                held.append(text[start:])
        if begun and not ended:
            yield MIDDLE if inside else BEGIN, "".join(held)


def pieces_of(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The pieces between separators as bytes, with the file and the begin of the range that each is read in. Rows of a
    partition come in the order of the file."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("value").cast("binary").alias("piece"), meta["file_path"].alias("file"), meta["file_block_start"].alias("begin")
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, Iterator[bytes]]]:
    """The pieces of a partition by range, streamed."""

    def chunks() -> Iterator[tuple[Range, list[bytes]]]:
        for batch in batches:
            pieces, files, begins = (batch.column(i) for i in range(3))
            start = 0
            while start < batch.num_rows:
                key = (files[start].as_py(), begins[start].as_py())
                end = batch.num_rows
                if (files[end - 1].as_py(), begins[end - 1].as_py()) != key:
                    end = next(i for i in range(start, end) if (files[i].as_py(), begins[i].as_py()) != key)
                yield key, pieces[start:end].to_pylist()
                start = end

    for key, group in itertools.groupby(chunks(), key=lambda c: c[0]):
        yield key, (piece for _, chunk in group for piece in chunk)


def effects_of(pieces: DataFrame, scanner: Scanner) -> dict[str, list[tuple[int, list[int]]]]:
    """For each file its ranges in order, by their begin, with their effects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, begin), group in _ranges(batches):
            made = [int(x) for x in scanner.effect(group, begin == 0)]
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin], pa.int64()), pa.array([made], pa.list_(pa.int64()))], names=["file", "begin", "effect"])

    found: dict[str, list[tuple[int, list[int]]]] = defaultdict(list)
    # sorted here: in Spark all ranges would be read once more to sample their order
    for r in sorted(pieces.mapInArrow(run, "file string, begin long, effect array<long>").collect()):
        found[r.file].append((r.begin, r.effect))
    return found


def records(spark: SparkSession, path: str, scanner: Scanner) -> DataFrame:
    """A row per record of the files: record, file, begin (of the range that it begins in) and n, its number in that range.

    A record that crosses ranges is the last of those that begin in its range; such rows come behind all others.
    """
    return measured(spark, path, scanner)[0]


def measured(spark: SparkSession, path: str, scanner: Scanner, width: Callable[[str], int] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The records, those of them that cross ranges, and the most that ``width`` finds of the others (0 without it)."""
    pieces = pieces_of(spark, path, scanner.separator)
    states: dict[Range, Any] = {}
    whole = True
    for file, ranges in effects_of(pieces, scanner).items():
        *starts, last = scanner.states([e for _, e in ranges])
        states |= {(file, begin): state for (begin, _), state in zip(ranges, starts, strict=True)}
        whole = whole and len(starts) == 1 and not last
    known = spark.sparkContext.broadcast(states)

    def cut(rows: Callable[[Iterator[tuple[int, str]]], Iterator[tuple[int, int, str]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (file, begin), group in _ranges(batches):
                for held in _batches(rows(scanner.cut(group, known.value[file, begin], begin == 0))):
                    n, part, text = zip(*held, strict=True)
                    same = [pa.repeat(pa.scalar(v, t), len(held)) for v, t in ((file, pa.string()), (begin, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *same, pa.array(n, pa.int64()), pa.array(part, pa.int32())], names=names)

        return pieces.mapInArrow(run, "record string, file string, begin long, n long, part int")

    def wholes(found: Iterator[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
        return ((n, part, text) for n, (part, text) in enumerate(found) if part == WHOLE)

    def parts(found: Iterator[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
        most = 0
        for n, (part, text) in enumerate(found):
            if part != WHOLE:
                yield n, part, text
            elif width:
                most = max(most, width(text))
        yield most, WIDEST, ""

    names = ["record", "file", "begin", "n", "part"]
    found = cut(wholes).drop("part")
    if whole and not width:
        return found, found.limit(0), 0
    # the few parts are kept: each use of the table would cut all ranges once more for them
    kept = saved(cut(parts))
    most = kept.where(F.col("part") == WIDEST).agg(F.max("n")).first()[0] or 0
    crossed = crossing(kept.where(F.col("part") != WIDEST))
    return found if whole else found.unionByName(crossed), crossed, most


def _batches(rows: Iterable[tuple[int, int, str]], most: int = 4096, chars: int = 1 << 22) -> Iterator[list[tuple[int, int, str]]]:
    """Rows in lists of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if len(held) == most or size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def crossing(parts: DataFrame) -> DataFrame:
    """Records that cross ranges, from their parts: a beginning, ranges within, an end."""
    late = F.when(F.col("part") == BEGIN, 1).otherwise(0)  # in a range one record ends before the next begins
    of = F.last(F.when(F.col("part") == BEGIN, F.col("begin")), ignorenulls=True).over(W.partitionBy("file").orderBy("begin", late))
    run = F.array_sort(F.collect_list(F.struct("begin", "late", "record")))
    joined = parts.withColumns({"late": late, "head": of}).groupBy("file", "head").agg(run.alias("run"), F.max(F.when(F.col("late") == 1, F.col("n"))).alias("n"))
    text = F.regexp_replace(F.array_join(F.col("run.record"), ""), r"\r?\n\z", "")  # the end of a file within quotes
    return joined.select(text.alias("record"), "file", F.col("head").alias("begin"), "n").where(F.trim("record") != "")
