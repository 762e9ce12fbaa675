"""Formulas for calculated columns, as Spark columns.

``revenue / customers``, ``if([unit price] > 20 and not rainy, "hot", "mild")``, ``year(date) & "-" & weekday(date)``.
A formula becomes one expression, so it runs inside generated code with the rest of the plan. Text is never executed.
"""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from .values import finite, kind_of, let, natural_key, number_text

#: The words and signs of a formula; Python's own parser reads them once they are spelled its way.
_WORD = re.compile(
    r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|\[(?P<col>[^\]]*)\]"
    r"|(?P<id>[^\W\d][\w.]*)(?P<call>\s*\()?|(?P<op>==|!=|<>|<=|>=|&&|\|\||[-+*/%^&=<>(),]))"
)
_SPELLED = {"^": "**", "=": "==", "<>": "!=", "&&": "and", "||": "or"}
_SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Pow: "^", ast.BitAnd: "&"}
_RELATIONS = {ast.Eq: "=", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class FormulaError(ValueError):
    """A formula that cannot be read, with a message for people."""


@dataclass(frozen=True)
class Value:
    """An expression and its kind: number, date, boolean or text."""

    c: Column
    kind: str

    def number(self) -> Column:
        if self.kind == "boolean":
            return self.c.cast("int").cast("double")
        if self.kind == "date":
            return F.unix_micros(self.c.cast("timestamp")).cast("double") / 1000.0
        return self.c.cast("double") if self.kind == "number" else F.lit(None).cast("double")

    def text(self) -> Column:
        if self.kind == "boolean":
            return F.when(self.c, "yes").when(~self.c, "no")
        return self.c if self.kind == "text" else number_text(self.number())

    def truth(self) -> Column:
        """Never null: missing is false, and so are 0 and the empty text."""
        made = self.c if self.kind == "boolean" else self.c != "" if self.kind == "text" else self.number() != 0
        return F.coalesce(made, F.lit(False))


def _math(f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda *xs: Value(finite(f(*[x.number() for x in xs])), "number")


def _round(x: Column, d: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), d if d is not None else F.lit(0.0))
    return F.floor(x * scale + 0.5).cast("double") / scale


def _if(c: Value, a: Value, b: Value) -> Value:
    if a.kind == b.kind:
        return Value(F.when(c.truth(), a.c).otherwise(b.c), a.kind)
    return Value(F.when(c.truth(), a.text()).otherwise(b.text()), "text")


def _least(pick: Callable[..., Column]) -> Callable[..., Value]:
    return lambda *xs: Value(pick(*[x.number() for x in xs]) if len(xs) > 1 else xs[0].number(), "number")


def _date(f: Callable[[Column], Column], kind: str = "number") -> Callable[[Value], Value]:
    def made(x: Value) -> Value:
        at = x.c if x.kind == "date" else F.timestamp_millis(x.number().cast("long"))
        return Value(f(at).cast("double") if kind == "number" else f(at), kind)

    return made


def _left(s: Value, n: Value) -> Value:
    k = n.number().cast("int")
    text = s.text()
    return Value(F.when(k >= 0, F.substring(text, F.lit(1), k)).otherwise(F.substring(text, F.lit(1), F.greatest(F.length(text) + k, F.lit(0)))), "text")


def _coalesce(*xs: Value) -> Value:
    same = len({x.kind for x in xs}) == 1
    return Value(F.coalesce(*[x.c if same else x.text() for x in xs]), xs[0].kind if same else "text")


def _bucket(x: Value, size: Value) -> Value:
    s = F.when(size.number() != 0, size.number())
    low = F.floor(x.number() / s).cast("double") * s
    return Value(F.concat(number_text(low), F.lit("–"), number_text(low + s)), "text")


def _text(f: Callable[[Column], Column], kind: str = "text") -> Callable[[Value], Value]:
    return lambda s: Value(f(s.text()), kind)


MANY = 1 << 20
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "if": (3, 3, _if),
    "round": (1, 2, _math(_round)),
    "abs": (1, 1, _math(F.abs)),
    "sqrt": (1, 1, _math(F.sqrt)),
    "log": (1, 1, _math(lambda x: F.when(x > 0, F.ln(x)))),
    "log10": (1, 1, _math(lambda x: F.when(x > 0, F.log10(x)))),
    "exp": (1, 1, _math(F.exp)),
    "floor": (1, 1, _math(lambda x: F.floor(x).cast("double"))),
    "ceil": (1, 1, _math(lambda x: F.ceil(x).cast("double"))),
    "pow": (2, 2, _math(F.pow)),
    "min": (1, MANY, _least(F.least)),
    "max": (1, MANY, _least(F.greatest)),
    "year": (1, 1, _date(F.year)),
    "month": (1, 1, _date(F.month)),
    "day": (1, 1, _date(F.dayofmonth)),
    "weekday": (1, 1, _date(lambda c: F.date_format(c, "EEE"), "text")),
    "daysbetween": (2, 2, _math(lambda a, b: F.floor((b - a) / 86_400_000 + 0.5).cast("double"))),
    "len": (1, 1, lambda s: Value(F.length(s.text()).cast("double"), "number")),
    "upper": (1, 1, _text(F.upper)),
    "lower": (1, 1, _text(F.lower)),
    "trim": (1, 1, _text(lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))),
    "left": (2, 2, _left),
    "contains": (2, 2, lambda s, q: Value(F.lower(s.text()).contains(F.lower(F.coalesce(q.text(), F.lit("")))), "boolean")),
    "concat": (1, MANY, lambda *xs: Value(F.concat(*[F.coalesce(x.text(), F.lit("")) for x in xs]), "text")),
    "ismissing": (1, 1, lambda x: Value(x.c.isNull(), "boolean")),
    "coalesce": (1, MANY, _coalesce),
    "bucket": (2, 2, _bucket),
}


def _compare(op: str, a: Value, b: Value) -> Value:
    texts = "text" in (a.kind, b.kind)
    if op in ("=", "!="):
        same = F.lower(a.text()) == F.lower(b.text()) if texts else a.number() == b.number()
        return Value(same if op == "=" else ~same, "boolean")
    x, y = (natural_key(a.c), natural_key(b.c)) if a.kind == b.kind == "text" else (a.number(), b.number())
    return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "boolean")


def _binary(op: str, a: Value, b: Value) -> Value:
    if op == "and":
        return Value(a.truth() & b.truth(), "boolean")
    if op == "or":
        return Value(a.truth() | b.truth(), "boolean")
    if op == "&":
        return FUNCTIONS["concat"][2](a, b)
    if op in _RELATIONS.values():
        return _compare(op, a, b)
    if op == "+" and "text" in (a.kind, b.kind):
        return Value(F.concat(a.text(), b.text()), "text")
    x, y = a.number(), b.number()
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: let(F.try_mod(x, y), lambda r: F.when(r == 0, 0.0).otherwise(r)), "^": lambda: F.pow(x, y)}
    return Value(finite(made[op]()), "number")


def _spelled(source: str, columns: list[str]) -> str:
    """A formula as a Python expression: columns are calls of ``_``, functions have ``f_`` before their name."""
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _WORD.match(source, at)
        if not m:
            raise FormulaError(f'Unexpected "{source[at:].strip()[:1]}" at position {at + 1}.')
        kind, at = m.lastgroup, m.end()
        name = m["id"]
        low = (name or "").lower()
        if kind == "num":
            out.append(repr(float(m["num"])))
        elif kind in ("dq", "sq"):
            out.append(repr(m[kind]))
        elif kind == "op":
            out.append(_SPELLED.get(m["op"], m["op"]))
        elif kind == "col":
            out.append(f"_({m['col'].strip()!r})")
        elif low in ("and", "or", "not"):
            out += [low, *"(" * (kind == "call")]
        elif kind == "call" and name not in columns:
            if low not in FUNCTIONS:
                raise FormulaError(f'Unknown function "{name}".')
            out.append(f"f_{low}(")
        else:
            flag = low in ("true", "yes", "false", "no")
            out += [str(low in ("true", "yes")) if flag else f"_({name!r})", *"(" * (kind == "call")]
    return " ".join(out)


def _column(df: DataFrame, name: str) -> Value:
    names = df.columns
    found = name if name in names else next((c for c in names if c.lower() == name.lower()), None)
    if found is None:
        near = difflib.get_close_matches(name, names, 1)
        raise FormulaError(f'There is no column called "{name}".' + (f' Did you mean "{near[0]}"?' if near else ""))
    kind = kind_of(df, found)
    return Value(F.col(f"`{found}`"), "text" if kind == "category" else kind)


def _value(node: ast.expr, df: DataFrame) -> Value:
    """The expression of a node of the parsed formula."""
    of = lambda x: _value(x, df)
    match node:
        case ast.Constant(value=bool() as v):
            return Value(F.lit(v), "boolean")
        case ast.Constant(value=float() as v):
            return Value(F.lit(v), "number")
        case ast.Constant(value=str() as v):
            return Value(F.lit(v), "text")
        case ast.Call(func=ast.Name(id="_"), args=[ast.Constant(value=name)], keywords=[]):
            return _column(df, name)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            least, most, made = FUNCTIONS[name[2:]]
            if not least <= len(args) <= most:
                raise FormulaError(f"{name[2:]}() needs {least if least == most else f'{least} or more'} values.")
            return made(*map(of, args))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return Value(-of(x).number(), "number")
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return of(x)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            v = of(x)
            return Value(F.when(v.c.isNotNull(), ~v.truth()), "boolean")
        case ast.BoolOp(op=op, values=values):
            return reduce(partial(_binary, "and" if isinstance(op, ast.And) else "or"), map(of, values))
        case ast.BinOp(left=x, op=op, right=y) if type(op) in _SIGNS:
            return _binary(_SIGNS[type(op)], of(x), of(y))
        case ast.Compare(left=x, ops=ops, comparators=ys):
            return reduce(lambda a, b: _binary(_RELATIONS[type(b[0])], a, of(b[1])), zip(ops, ys, strict=True), of(x))
    raise FormulaError("The formula has a part that cannot be read. Is an operator missing?")


def compiled(source: str, df: DataFrame) -> Value:
    """The formula over the columns of ``df``."""
    if not source.strip():
        raise FormulaError("Type a formula, for example: price * quantity")
    try:
        tree = ast.parse(_spelled(source, df.columns), mode="eval")
    except SyntaxError as e:
        raise FormulaError("The formula cannot be read. Is an operator, a comma or a bracket missing?") from e
    return _value(tree.body, df)


def calculate(df: DataFrame, name: str, source: str) -> DataFrame:
    """``df`` with a calculated column; numbers keep 12 significant digits."""
    from ..operators.cleaning import new_name, put
    from .values import round_digits

    v = compiled(source, df)
    kind = "number" if v.kind in ("number", "date") else "boolean" if v.kind == "boolean" else "category"
    return put(df, new_name(df, name), round_digits(v.number()) if kind == "number" else v.c, kind)
