"""Tables from delimited text and JSON, with the kinds of their columns read off the values.

Text is read as strings; aggregations over all columns decide their kinds, and the typed columns are a projection over
the scan, so nothing is kept twice.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qs, unquote, urlsplit
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import COMMA_NUMBER, DATE_LIKE, FALSE, ISO_TIME, MISSING, RAW, TRUE, TWO_WAY_DATE, marked, parse, parse_date, reads_date, reads_number, trimmed
from ..operators.storage import ensure_checkpoint_dir
from .records import Delimited, Elements, measured, records

# Candidates in order of preference, how much of a file tells its delimiter, and what agreement and fields count.
DELIMITERS, SAMPLE_CHARS, SAMPLE_LINES, AGREED, FIELDS = (",", "\t", ";", "|"), 50_000, 20, 100, 50
#: Least share of numbers or dates for a kind, most of codes among numbers, longest mean and share of labels.
ENOUGH, CODES, LABEL_LENGTH, LABEL_SHARE, LABELS = 0.95, 0.05, 40, 0.5, 25


def encoding_of(head: bytes) -> str:
    """By the byte order mark, else UTF-8 if the bytes are that, else Windows-1252. ``head`` may end within a character."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return "windows-1252"
    return "UTF-8"


def delimiter_of(text: str) -> str:
    """The candidate that the first lines agree on most, outside quotes; then the more frequent, then the earlier one."""
    lines = [x for x in re.split(r"\r\n|\r|\n", text[:SAMPLE_CHARS]) if x.strip()][:SAMPLE_LINES]
    bare = [re.sub(r'"[^"]*"?', "", x) for x in lines]
    best, most = DELIMITERS[0], 0.0
    for d in DELIMITERS:
        counts = [x.count(d) for x in bare]
        if counts and counts[0]:
            agreed = sum(c == counts[0] for c in counts) / len(counts)
            if (score := AGREED * agreed + min(counts[0], FIELDS)) > most:
                best, most = d, score
    return best


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Blank names become Column 1, Column 2, ...; repeated ones get a number."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = (name or "").strip() or f"Column {i + 1}"
        k, made = 1, base
        while made in out:
            k, made = k + 1, f"{base} ({k + 1})"
        out.append(made)
    return out


#: What the bytes 80 to 9F mean in Windows-1252; Spark reads them as Latin-1.
_LATIN = "".join(chr(b) for b in range(0x80, 0xA0))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def _head(spark: SparkSession, path: str, size: int = 4 * SAMPLE_CHARS) -> bytes:
    """The first bytes of a file, or of the first file of a folder, from whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getFileStatus(where).isDirectory():
        found = sorted((f.getPath().toString(), f) for f in store.listStatus(where) if f.isFile() and f.getPath().getName()[0] not in "_.")
        if not found:
            return b""
        where = found[0][1].getPath()
    stream = store.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _fields(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Number of fields of a record, and whether it ends within quotes. A quote counts at the start of a field only."""
    d = re.escape(delimiter)
    quoted = line.contains('"')
    bare = F.when(quoted, F.regexp_replace(line, rf'(?s)(^|{d})"(?:[^"]++|"")*+"(?!")', "$1")).otherwise(line)
    is_open = quoted & bare.rlike(rf'(^|{d})"')
    closed = F.when(is_open, F.regexp_replace(bare, rf'(?s)(^|{d})".*', "$1")).otherwise(bare)
    count = F.length(closed) - F.length(F.replace(closed, F.lit(delimiter), F.lit(""))) + 1
    return count, is_open


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """All columns as strings. Quotes may hold delimiters and line ends; extra fields widen the table.

    The head of the first file tells the byte order mark and the delimiter. One pass over all lines tells the rest: whether
    all bytes are UTF-8, the most fields of a line, and whether a quoted field goes on beyond its line. If one does,
    records are cut by ``records``, which many tasks do for one file too; those that cross the ranges of tasks come last. UTF-16
    is read whole, a task a file.
    """
    head = _head(spark, path)
    marked_as = encoding or encoding_of(head)
    wide = marked_as.startswith("UTF-16")
    text = head.decode("windows-1252" if marked_as == "windows-1252" else marked_as, "replace").removeprefix("\ufeff")
    delimiter = delimiter or ("\t" if path.endswith(".tsv") else delimiter_of(text))
    first = next((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)), None)
    if first is None:
        return spark.createDataFrame([], "`Column 1` string")
    most, multi = len(first), wide
    if not wide:
        fields, is_open = _fields(F.col("value"), delimiter)
        found = spark.read.text(path).agg(F.max(fields).alias("most"), F.bool_or(is_open).alias("open"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")).first()
        multi = bool(found["open"])
        most = max(most, found["most"] or 0) if not multi else most
        encoding = encoding or ("windows-1252" if not found["utf8"] else marked_as)
    encoding = encoding or marked_as
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": str(multi).lower(), "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    schema = lambda: ", ".join(f"c{i} string" for i in range(most))
    if multi and not wide:
        scanner = Delimited(delimiter, encoding)
        cut, crossed, widest = measured(spark, path, scanner, scanner.width)
        cut = cut.where(~((F.col("begin") == 0) & (F.col("n") == 0)))
        most = max(most, widest, crossed.agg(F.max(_fields(F.col("record"), delimiter)[0])).first()[0] or 0)
        names = unique_headers([*first, *[None] * (most - len(first))])
        return cut.select(F.from_csv("record", schema(), options).alias("r")).select("r.*").toDF(*names)
    reader = spark.read.options(**options).option("encoding", "ISO-8859-1" if encoding == "windows-1252" else encoding)
    if multi:
        whole = reader.option("header", False).option("columnNameOfCorruptRecord", "_whole").schema(f"{schema()}, _whole string").csv(path)
        # Spark wants another column beside the record
        found = whole.agg(F.max(F.when(F.col("_whole").isNotNull(), _fields(F.col("_whole"), delimiter)[0])).alias("most"), F.count("c0")).first()
        most = max(most, found["most"] or 0)
    names = unique_headers([*first, *[None] * (most - len(first))])
    rows = reader.option("header", True).option("enforceSchema", True).schema(schema()).csv(path).toDF(*names)
    if encoding != "windows-1252":
        return rows
    return rows.select(*[F.translate(f"`{c}`", _LATIN, _WINDOWS).alias(c) for c in names])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects of an array, of the first array in an object, or of lines, as strings; columns in the order seen first.

    Nested values keep their JSON text. Lines that are objects each are split as any text; of other files the array is
    found by brackets and its elements are cut by many tasks. An element that is no object is a row of blanks.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("o"))
    start = _head(spark, path).decode("utf-8", "replace").lstrip("\ufeff \r\n\t")[:1]
    n, bad = lines.agg(F.count("*"), F.count_if(F.col("o").isNull())).first() if start != "[" else (0, 0)
    if n > 1 and not bad:
        rows = lines.withColumn("r", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("begin"), F.monotonically_increasing_id().alias("n")))
    else:
        rows = records(spark, path, Elements()).select(F.from_json("record", "map<string,string>").alias("o"), F.struct("file", "begin", "n").alias("r"))
    keys = rows.select("r", F.posexplode(F.map_keys("o")).alias("p", "k"))
    order = [r.k for r in keys.groupBy("k").agg(F.min(F.struct("r", "p")).alias("at")).orderBy("at").collect()]
    whole_number = lambda c: F.when(c.rlike(r"^-?\d+\.0+$"), F.regexp_replace(c, r"\.0+$", "")).otherwise(c)
    value = lambda k: whole_number(F.get(F.array(F.col("o")[k]), F.lit(0)))
    return rows.select(*[F.coalesce(value(k), F.lit("")).alias(n) for k, n in zip(order, unique_headers(order), strict=True)])


@dataclass(frozen=True)
class Kind:
    """How a column of texts is read."""

    name: str
    day_first: bool | None = None
    decimal_comma: bool = False


#: Fixed pattern: numbers whose dots can only be of thousands.
THOUSANDS = r"^[-+(]?\s*[$€£¥]?\s?[1-9]\d{0,2}(\.\d{3})+\)?\s?[$€£¥%]?$"


#: Fixed pattern: what a number with an exponent can look like, among others.
EXPONENT = r"^\(?\s*[-+]?(?:[$€£¥]\s?)?[\d.,]+[eE][-+]?\d+%?\s*\)?$"


def shape(t: Column, lower: Column) -> Column:
    """A text that is a number, date or flag where ``t`` is one, and the same for very many texts.

    Yes and no stay, and what begins like a date or has an exponent, as whether it is one hangs on its digits. Of all other
    texts only the places of zeros and of other digits count, and of those with letters only whether they begin with a zero.
    """
    date = t.rlike(DATE_LIKE) & ((F.length(t) <= 64) | t.rlike(ISO_TIME))
    worded = F.when(t.rlike(EXPONENT), t).when(t.rlike(r"^[-+]?0\d"), F.lit("01x")).otherwise(F.lit("1x"))
    return (
        F.when(~t.rlike(r"\d"), F.when(lower.isin(*TRUE, *FALSE), lower).otherwise(F.lit("x")))
        .when(date, t)
        .when(t.rlike(r"\p{L}"), worded)
        .otherwise(F.regexp_replace(t, "[1-8]", "9"))
    )


@dataclass(frozen=True)
class Profile:
    """What tells a column's kind: numbers of its texts that read as something, all of which add up over tables.

    ``a`` and ``b`` are the greatest first and second parts of dates that can be read two ways, ``length`` is the sum of
    lengths, and the number of different texts lies between ``least`` and ``most``.
    """

    n: int = 0
    flag: int = 0
    number: int = 0
    comma: int = 0
    only: int = 0
    dot: int = 0
    code: int = 0
    date: int = 0
    a: int = 0
    b: int = 0
    dotted: int = 0
    length: int = 0
    dots: int = 0
    thousands: int = 0
    least: int = 0
    most: int = 0

    def with_rows_of(self, other: Profile) -> Profile:
        """The profile of both columns' texts together."""
        summed = {f.name: getattr(self, f.name) + getattr(other, f.name) for f in fields(self)}
        return Profile(**summed | {k: max(getattr(self, k), getattr(other, k)) for k in ("a", "b", "least")})


def _given(df: DataFrame) -> DataFrame:
    """(i, t, lower): the texts of all columns that are not missing, by the number of their column."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("s")) for i, c in enumerate(df.columns)])
    long = df.select(F.inline(each)).select("i", trimmed(F.col("s")).alias("t"))
    return long.withColumn("lower", F.lower("t")).where(~F.col("lower").isin(*MISSING))


def profiles(df: DataFrame) -> dict[str, Profile]:
    """The profile of every column of texts from one pass over all rows. The patterns are tried on the different shapes of
    the values, not on each value."""
    if not df.columns:
        return {}
    given = _given(df)
    shapes = given.select("i", shape(F.col("t"), F.col("lower")).alias("shape"), F.length("t").alias("length"), F.col("t").contains(".").alias("dot"))
    shapes = shapes.groupBy("i", "shape").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.count_if("dot").alias("dots"))
    t = F.col("shape")
    two = lambda k: F.regexp_extract(t, TWO_WAY_DATE, k).try_cast("int")
    digit = t.rlike(r"\d")
    read = shapes.select(
        "i", "shape", "n", "length", "dots", digit.alias("digit"), t.isin(*TRUE, *FALSE).alias("flag"), (digit & reads_number(t)).alias("number"),
        (digit & reads_number(t, True)).alias("comma"), (t.contains(",") & t.rlike(COMMA_NUMBER)).alias("with_comma"), (digit & reads_date(t)).alias("date"),
    )
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    made = read.groupBy("i").agg(
        F.sum("n").alias("n"), many(F.col("flag")).alias("flag"), many(F.col("number")).alias("number"), many(F.col("comma")).alias("comma"),
        many(F.col("with_comma") & ~F.col("number")).alias("only"), many(F.col("number") & ~F.col("comma")).alias("dot"),
        many(F.col("digit") & t.rlike(r"^[-+]?0\d|^\d{16,}$")).alias("code"), many(F.col("date")).alias("date"),
        F.max(F.when(F.col("date"), two(1))).alias("a"), F.max(F.when(F.col("date"), two(2))).alias("b"),
        many(F.col("date") & t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$")).alias("dotted"), F.sum("length").alias("length"),
        F.sum("dots").alias("dots"), many(t.contains(".") & t.rlike(THOUSANDS)).alias("thousands"),
    )
    found = {r["i"]: {k: v or 0 for k, v in r.asDict().items() if k != "i"} for r in made.collect()}
    return {c: Profile(**found[i], most=found[i]["n"]) if i in found else Profile() for i, c in enumerate(df.columns)}


def different(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact numbers of different texts of some columns."""
    held = df.select(*[F.col(f"`{c}`") for c in columns])
    counted = _given(held).groupBy("i", "t").agg(F.lit(1)).groupBy("i").agg(F.count("*").alias("k"))
    return {columns[r["i"]]: r["k"] for r in counted.collect()}


def decided(known: dict[str, Profile], count: Callable[[list[str]], dict[str, int]]) -> tuple[dict[str, Kind], dict[str, Profile]]:
    """The kinds that profiles tell, and the profiles. ``count`` gives the numbers of different texts of columns for which
    they are not known well enough; the profiles then have them.

    Yes/no if all values are that; number if 95 % are and less than 5 % look like codes (leading zeros, 16 digits and
    more); date if 95 % are; label if short and repeated; else text. A column of decimal commas is told by values that
    read only so, day-first dates by parts over 12 or by dots. If one column of numbers has decimal commas, dots of the
    others that can be of thousands are.
    """
    out: dict[str, Kind] = {}
    short, of_dots = [], []
    for c, r in known.items():
        comma = r.only > 0 and not r.dot
        if not r.n:
            out[c] = Kind("text")
        elif r.flag == r.n:
            out[c] = Kind("boolean")
        elif (r.comma if comma else r.number) >= ENOUGH * r.n and r.code < CODES * r.n:
            out[c] = Kind("number", decimal_comma=comma)
            if not comma and r.dots and r.dots == r.thousands:
                of_dots.append(c)
        elif r.date >= ENOUGH * r.n:
            out[c] = Kind("date", day_first=True if r.dotted or r.a > 12 and r.b <= 12 else False if r.b > 12 and r.a <= 12 else None)
        else:
            out[c] = Kind("text")
            if r.length <= LABEL_LENGTH * r.n:
                short.append(c)
    if any(k.decimal_comma for k in out.values()):
        out |= {c: Kind("number", decimal_comma=True) for c in of_dots}
    limit = {c: max(LABELS, LABEL_SHARE * known[c].n) for c in short}
    open_ = [c for c in short if known[c].least <= limit[c] < known[c].most]
    if open_:
        known = known | {c: replace(known[c], least=k, most=k) for c, k in count(open_).items()}
    return out | {c: Kind("category") for c in short if known[c].most <= limit[c]}, known


def kinds(df: DataFrame) -> dict[str, Kind]:
    """The kind of every column of texts from one pass over all rows, and one more that counts the different values of
    columns that are neither numbers, dates nor yes/no and short."""
    return decided(profiles(df), lambda columns: different(df, columns))[0]


def typed(df: DataFrame, known: dict[str, Kind] | None = None) -> DataFrame:
    """``df`` with each column read as its kind, and the texts in a struct that is pruned where it is not used."""
    known = known or kinds(df)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in known]
    columns = [marked(parse(F.col(f"`{c}`"), k.name, k.day_first, k.decimal_comma), c, k.name) for c, k in known.items()]
    return df.select(*rest, *columns, F.struct(*[F.col(f"`{c}`") for c in known]).alias(RAW))


def load(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """A table of a text or JSON file with typed columns."""
    head = _head(spark, path).decode("latin-1").lstrip("ï»¿ \r\n\t")
    as_json = path.endswith((".json", ".jsonl")) or head[:1] in ("[", "{")
    return typed(read_json(spark, path) if as_json else read_delimited(spark, path, delimiter, encoding))


def load_stacked(spark: SparkSession, paths: Sequence[str], column: str = "source") -> DataFrame:
    """Several files with the same columns (without regard to case and blanks) as one table that names each row's file."""
    from ..operators.combine import plain

    parts = {p: read_delimited(spark, p) for p in paths}
    first = next(iter(parts.values()))
    wanted = sorted(map(plain, first.columns))
    same = {p: df for p, df in parts.items() if sorted(map(plain, df.columns)) == wanted}
    named = {plain(c): c for c in first.columns}
    whole = None
    for p, df in same.items():
        part = df.toDF(*[named[plain(c)] for c in df.columns]).withColumn(column, F.lit(p.rsplit("/", 1)[-1]))
        whole = part if whole is None else whole.unionByName(part)
    return typed(whole)


def download_link(url: str) -> str:
    """The address of the data behind an address that people copy: shared sheets and files in code repositories."""
    parts = urlsplit(url.strip())
    if parts.scheme not in ("http", "https"):
        raise ValueError("Only http and https addresses can be loaded.")
    if parts.netloc == "docs.google.com" and (m := re.match(r"/spreadsheets/d/([\w-]+)", parts.path)):
        gid = parse_qs(parts.fragment).get("gid") or parse_qs(parts.query).get("gid") or ["0"]
        return f"https://docs.google.com/spreadsheets/d/{m[1]}/export?format=csv&gid={gid[0]}"
    if parts.netloc == "github.com" and (m := re.match(r"/([^/]+)/([^/]+)/blob/(.+)", parts.path)):
        return f"https://raw.githubusercontent.com/{m[1]}/{m[2]}/{m[3]}"
    return url.strip()


def link_name(url: str) -> str:
    """A file name for the data behind an address: the end of its path, or the site."""
    parts = urlsplit(url)
    if parts.netloc == "docs.google.com":
        return "Google Sheet.csv"
    last = unquote(next((x for x in reversed(parts.path.split("/")) if x), ""))
    return last if re.search(r"\.\w{2,5}$", last) else f"{last or parts.netloc}.csv"


def fetched(spark: SparkSession, url: str, timeout: float = 60.0) -> str:
    """The data behind an address as a file in the shared folder, for ``load``. A web page is refused.

    The driver copies the bytes a piece at a time, so no more than a piece is held.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/link-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{re.sub(r'[^\w.-]', '_', link_name(download_link(url)))}")
    with urlopen(download_link(url), timeout=timeout) as found:  # http and https only, as download_link checks
        piece = found.read(1 << 20)
        if re.match(rb"\s*<(!doctype|html)", piece, re.I):
            raise ValueError("That link opens a web page, not a data file.")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        try:
            while piece:
                out.write(bytearray(piece))
                piece = found.read(1 << 20)
        finally:
            out.close()
    return where.toString()


def responses(df: DataFrame, fields: Sequence[dict], answers: str = "values", submitted: str = "submitted") -> DataFrame:
    """A table of form answers: ``answers`` is a column of JSON objects by field id.

    A field has id, label, type and for choices options. Boxes that can be ticked together become a text and, up to
    eight of them, a yes/no column each.
    """
    out = [marked(parse_date(F.col(submitted)), "Submitted", "date")]
    kinds_of = {"rating": "number", "number": "number", "date": "date", "yesno": "boolean", "choice": "category"}
    names = iter(unique_headers([f["label"] for f in fields]))
    for f in fields:
        name, raw = next(names), F.get_json_object(answers, f"$['{f['id']}']")
        if f["type"] == "checkboxes":
            picked = F.from_json(raw, "array<string>")
            out.append(marked(F.array_join(picked, "; "), name, "category"))
            if len(f["options"]) <= 8:
                out += [marked(F.when(picked.isNotNull(), F.array_contains(picked, o)), f"{name}: {o}", "boolean") for o in f["options"]]
        else:
            kind = kinds_of.get(f["type"], "text")
            out.append(marked(parse(raw, kind), name, kind))
    return df.select(*out)


def merged_responses(parts: Sequence[DataFrame], key: str = "id", order: str = "received") -> DataFrame:
    """Answers of several deliveries, each once: the one received first."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    first = whole.groupBy(key).agg(F.min_by(F.struct(*whole.columns), order).alias("_row"))
    return first.select("_row.*")


def to_lines(rows: Sequence[dict]) -> str:
    """Objects as JSON lines, the form that ``read_json`` can split."""
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
