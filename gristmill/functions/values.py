"""Expressions that read values from text and write them as text.

Kinds of columns: number (double), date (timestamp), boolean, category and text (strings). A frame made from text keeps
the texts in a struct column ``_raw``; unused parts of it are pruned from the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

RAW = "_raw"
# Texts that count as missing, and those of yes and no.
MISSING = ("", "na", "n/a", "nan", "null", "none", "-", "--", "?", "missing", "undefined", "#n/a")
TRUE, FALSE = ("true", "yes", "y", "t"), ("false", "no", "n", "f")
# Fixed patterns of numbers and dates.
NUMBER = r"(?i)^[-+]?(?:[$€£¥]\s?)?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?(?:e[-+]?\d+)?%?$"
COMMA_NUMBER = r"^[-+]?(?:[$€£¥]\s?)?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?\s?(?:[$€£¥]|%)?$"
ISO_DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
SLASH_DATE = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
TWO_WAY_DATE = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$"
MONTH_FIRST = r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$"
MONTH_SECOND = r"^(\d{1,2}) ([A-Za-z]{3,9})\.?,? (\d{4})$"
ISO_TIME = r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?(Z|[+-]\d{2}:?\d{2})?$"
DATE_LIKE = r"^(\d{4}[-/]\d|\d{1,2}[/.]\d{1,2}[/.]\d{4}$|[A-Za-z]{3,9}\.? \d|\d{1,2} [A-Za-z])"
MONTH_NAME = r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space at both ends, Unicode's too."""
    return F.btrim(c, F.lit(SPACE))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*MISSING)


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def parse_number(c: Column, decimal_comma: bool = False) -> Column:
    """Number of a text such as 1,234.5, $20, 45%, 1e3 or (1,234), else null."""

    def read(s: Column) -> Column:
        wrapped = s.rlike(r"^\(.+\)$")
        body = F.when(wrapped, trimmed(F.regexp_extract(s, r"^\((.+)\)$", 1))).otherwise(s)
        return let(F.struct(body.alias("t"), wrapped.alias("w")), number)

    def number(b: Column) -> Column:
        t, wrapped = b["t"], b["w"]
        fits = t.rlike(r"\d") & t.rlike(COMMA_NUMBER if decimal_comma else NUMBER)
        if decimal_comma:
            plain = F.replace(F.replace(F.regexp_replace(t, r"[$€£¥%\s]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        else:
            fits = fits & ~(wrapped & t.rlike(r"^[-+]"))
            plain = F.regexp_replace(t, r"[$€£¥,%\s]", "")
        return F.when(fits, let(plain.try_cast("double"), lambda v: finite(F.when(wrapped, -v).otherwise(v))))

    return let(trimmed(c), read)


def reads_number(t: Column, decimal_comma: bool = False) -> Column:
    """Whether ``parse_number`` reads a trimmed text, without its value: patterns alone, but for numbers with exponents."""
    wrapped = t.rlike(r"^\(.+\)$")
    body = F.when(wrapped, trimmed(F.regexp_extract(t, r"^\((.+)\)$", 1))).otherwise(t)
    if decimal_comma:
        return body.rlike(COMMA_NUMBER)
    fits = body.rlike(NUMBER) & body.rlike(r"\d") & ~(wrapped & body.rlike(r"^[-+]"))
    return F.when(t.rlike("[eE]"), parse_number(t).isNotNull()).otherwise(fits)


def reads_date(t: Column) -> Column:
    """Whether ``parse_date`` reads a trimmed text; only texts that begin like a date are read."""
    return F.when(t.rlike(DATE_LIKE), parse_date(t).isNotNull()).otherwise(F.lit(False))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0))


def parse_date(c: Column, day_first: bool | None = None) -> Column:
    """UTC timestamp of a text in one of seven formats, else null."""
    return let(trimmed(c), lambda s: _read_date(s, day_first))


def _read_date(s: Column, day_first: bool | None) -> Column:
    part = lambda p, i: F.regexp_extract(s, p, i).try_cast("int")
    month = lambda name: F.when(
        name.rlike(MONTH_NAME), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")
    )
    a, b, y = part(TWO_WAY_DATE, 1), part(TWO_WAY_DATE, 2), part(TWO_WAY_DATE, 3)
    first = (a > 12) if day_first is None else F.lit(day_first)
    offset = F.regexp_replace(F.regexp_extract(s, ISO_TIME, 7), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    second = F.coalesce(F.regexp_extract(s, ISO_TIME, 6).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    clock = F.try_make_timestamp(*[part(ISO_TIME, i) for i in range(1, 6)], second)
    hours, minutes = F.substring(offset, 2, 2).try_cast("int"), F.substring(offset, 5, 2).try_cast("int")
    shift = F.when(F.substring(offset, 1, 1) == "-", 1).otherwise(-1) * (hours * 60 + minutes)
    moved = F.when(hours.isNull(), clock).otherwise(F.timestamp_micros(F.unix_micros(clock) + shift.cast("long") * 60_000_000))
    return (
        F.when(s.rlike(ISO_DATE), _day(*[part(ISO_DATE, i) for i in (1, 2, 3)]))
        .when(s.rlike(SLASH_DATE), _day(*[part(SLASH_DATE, i) for i in (1, 2, 3)]))
        .when(s.rlike(TWO_WAY_DATE), F.when(first, _day(y, b, a)).otherwise(_day(y, a, b)))
        .when(s.rlike(MONTH_FIRST), _day(part(MONTH_FIRST, 3), month(F.regexp_extract(s, MONTH_FIRST, 1)), part(MONTH_FIRST, 2)))
        .when(s.rlike(MONTH_SECOND), _day(part(MONTH_SECOND, 3), month(F.regexp_extract(s, MONTH_SECOND, 2)), part(MONTH_SECOND, 1)))
        .when(s.rlike(ISO_TIME), moved)
    )


def parse_boolean(c: Column) -> Column:
    s = F.lower(trimmed(c))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def parse(c: Column, kind: str, day_first: bool | None = None, decimal_comma: bool = False) -> Column:
    """Typed value of a text of the kind; null if missing or not of it."""
    typed = {
        "number": lambda: parse_number(c, decimal_comma),
        "date": lambda: parse_date(c, day_first),
        "boolean": lambda: parse_boolean(c),
    }.get(kind, lambda: trimmed(c))()
    return F.when(~is_missing(c), typed)


def round_digits(c: Column, digits: int = 12) -> Column:
    """A double rounded to significant digits, as calculated values are kept."""
    return F.format_string(f"%.{digits - 1}e", c.cast("double")).try_cast("double")


def number_text(c: Column) -> Column:
    """12 significant digits without trailing zeros."""

    def write(v: Column) -> Column:
        digits = v.try_cast("decimal(38,18)").cast("string")
        text = F.regexp_replace(digits, r"\.?0+$", "")
        return F.when(v == 0, "0").when(v == F.floor(v), v.try_cast("decimal(38,0)").cast("string")).otherwise(text)

    return F.when(c.isNotNull(), let(round_digits(c), write))


def kind_of(df: DataFrame, name: str) -> str:
    """Kind of a column: what its metadata say, else by its type."""
    f = df.schema[name]
    if "kind" in f.metadata:
        return f.metadata["kind"]
    t = f.dataType
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "date"
    return "boolean" if isinstance(t, T.BooleanType) else "category"


def marked(c: Column, name: str, kind: str) -> Column:
    return c.alias(name, metadata={"kind": kind})


def has_raw(df: DataFrame, name: str) -> bool:
    return RAW in df.columns and name in df.schema[RAW].dataType.names


def text_of(df: DataFrame, name: str) -> Column:
    """The text that a column was read from, else its value as text."""
    if has_raw(df, name):
        return F.col(RAW)[name]
    kind, c = kind_of(df, name), F.col(f"`{name}`")
    if kind == "number":
        return number_text(c.cast("double"))
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "boolean":
        return F.when(c, "yes").when(~c, "no")
    return c.cast("string")


def natural_key(c: Column) -> Column:
    """Sorts texts with their digit runs as numbers, ignoring case and accents."""
    run = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def keyed(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(part)

    return F.collate(F.array_join(F.transform(run, keyed), ""), "UNICODE_CI_AI")


def join_key(df: DataFrame, name: str) -> Column:
    """Key of a column for joins: numbers by value (up to 15 digits), texts without regard to case and outer blanks.

    Blanks are null. A typed number column needs no text at all."""
    value = lambda n: F.concat(F.lit("#"), n.cast("string"))
    if kind_of(df, name) == "number" and not has_raw(df, name):
        c = F.col(f"`{name}`")
        whole = isinstance(df.schema[name].dataType, T.IntegralType)
        return F.when(F.abs(c) < 10**15, value(c.cast("double"))).otherwise(c.cast("string")) if whole else value(c.cast("double"))

    def key(s: Column) -> Column:
        few = F.length(F.regexp_replace(s, r"\D", "")) <= 15
        return let(parse_number(s), lambda n: F.when(s == "", None).when(n.isNotNull() & few, value(n)).otherwise(F.lower(s)))

    return let(trimmed(text_of(df, name)), key)
