"""One query per formula function or operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.formula import compiled
from ..functions.values import round_digits
from .registry import query, table

_PARTS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _formula(source: str, of: str, key: str, digits: int | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, of)
        v = compiled(source, df)
        value = v.number() if v.kind in ("number", "date") else v.c
        return df.select(key, (F.round(value, digits) if digits is not None else value).alias("v"))

    return run


def _add(name: str, source: str, sql: str, of: str = "part", key: str = "p_partkey", digits: int | None = None) -> None:
    shown = f"round({sql}, {digits})" if digits is not None else sql
    query(f"formula_{name}", f"SELECT {key}, {shown} AS v FROM {of}")(_formula(source, of, key, digits))


_O = {"of": "orders", "key": "o_orderkey"}
_add("arithmetic", "p_retailprice * 1.2 - p_size + 3", "p_retailprice * 1.2 - p_size + 3", digits=6)
_add("divide_by_zero", "p_retailprice / (p_size - 10)", "CASE WHEN p_size <> 10 THEN p_retailprice / (p_size - 10) END", digits=6)
_add("remainder", "(p_size - 25) % 7", "CAST((p_size - 25) % 7 AS DOUBLE)")
_add("power", "-2 ^ 2 + p_size ^ 2 ^ 1", "CAST(-4 + p_size * p_size AS DOUBLE)")
_add("equals", 'p_brand = "brand#12"', "lower(p_brand) = 'brand#12'")
_add("not_equals", "p_size <> 10", "p_size <> 10")
_add("compare_text", 'p_brand < "Brand#20"', "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) < 20")
_add("compare", "p_size >= 20 and p_size < 30", "p_size >= 20 AND p_size < 30")
_add("logic", "not (p_size > 20) or p_retailprice > 950", "NOT (p_size > 20) OR p_retailprice > 950")
_add("join_text", 'p_brand & " / " & p_size', "p_brand || ' / ' || p_size")
_add("if", 'if(p_size > 25, "large", "small")', "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END")
_add("if_mixed", 'if(p_size > 25, p_size, "small")', "CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'small' END")
_add("round", "round(p_retailprice / 7, 1)", "floor(p_retailprice / 7 * 10 + 0.5) / 10")
_add("round_half_up", "round((p_size - 25) / 2)", "floor((p_size - 25) / 2.0::DOUBLE + 0.5)")
_add("abs_sqrt", "abs(p_size - 25) + sqrt(p_size)", "abs(p_size - 25) + sqrt(p_size)", digits=8)
_add("sqrt_negative", "sqrt(p_size - 25)", "CASE WHEN p_size >= 25 THEN sqrt(p_size - 25) END", digits=8)
_add("logs", "log(p_retailprice) + log10(p_retailprice)", "ln(p_retailprice) + log10(p_retailprice)", digits=8)
_add("log_negative", "log(p_size - 25)", "CASE WHEN p_size > 25 THEN ln(p_size - 25) END", digits=8)
_add("exp", "exp(p_size / 10)", "exp(p_size / 10.0::DOUBLE)", digits=6)
_add("floor_ceil", "floor(p_retailprice / 3) + ceil(p_retailprice / 3)", "floor(p_retailprice / 3) + ceil(p_retailprice / 3)")
_add("min_max", "max(p_size, 10, 20) - min(p_size, 30)", "CAST(greatest(p_size, 10, 20) - least(p_size, 30) AS DOUBLE)")
_add("year_month_day", "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)", "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS DOUBLE)", **_O)
_add("weekday", "weekday(o_orderdate)", "strftime(o_orderdate, '%a')", **_O)
_add("days_between", "daysBetween(l_shipdate, l_shipdate) + l_quantity", "l_quantity", "lineitem", "l_orderkey")
_add("length", "len(p_name)", "CAST(length(p_name) AS DOUBLE)")
_add("case", "upper(p_type) & lower(p_brand)", "upper(p_type) || lower(p_brand)")
_add("trim", 'trim("  " & p_name & " ")', "trim(p_name)")
_add("left", "left(p_name, 4)", "substr(p_name, 1, 4)")
_add("left_negative", "left(p_name, -2)", "substr(p_name, 1, greatest(length(p_name) - 2, 0))")
_add("contains", 'contains(p_type, "steel")', "lower(p_type) LIKE '%steel%'")
_add("concat", 'concat(p_brand, "-", p_size)', "p_brand || '-' || p_size")
_add("bucket", "bucket(p_size, 10)", "CAST(p_size // 10 * 10 AS VARCHAR) || '–' || CAST(p_size // 10 * 10 + 10 AS VARCHAR)")
_GAPS = "(SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


def _events(source: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
        return df.select("event_id", compiled(source, df).c.alias("v"))

    return run


query("formula_missing", f"SELECT event_id, value IS NULL AS v FROM {_GAPS}")(_events("isMissing(value)"))
query("formula_coalesce", f"SELECT event_id, coalesce(value, -1) AS v FROM {_GAPS}")(_events("coalesce(value, -1)"))
query("formula_null_logic", f"SELECT event_id, coalesce(value > 50, false) AS v FROM {_GAPS}")(_events("value > 50 and true"))


@query("formula_calculated", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _calculated(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    net = round_digits(compiled("l_extendedprice * (1 - l_discount)", df).number())
    return df.select("l_orderkey", "l_linenumber", F.round(net, 4).alias("net"))
