"""A small expression language that compiles to Columns.

Grammar, from loose to tight: ``c ? a : b``, ``|| or``, ``&& and``,
``== !=``, ``< <= > >=``, ``+ -``, ``* / %``, unary ``- !``, then calls,
indexing ``a[i]`` (from 0; null out of range) and properties ``a.b``. Numbers are
doubles. Names are columns; ``$name`` is one as well.

Dialects differ in a few functions and in division by zero: "expr" gives
infinity, "null" gives null, "error" raises.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(\$?[A-Za-z_]\w*)|(\|\||&&|==|!=|<=|>=|[-+*/%<>!?:(),.\[\]]))")
BINARY = {"||": 1, "or": 1, "&&": 2, "and": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


class ExpressionError(ValueError):
    """An expression that cannot be read."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        kind = "number" if m[1] else "string" if m[2] else "name" if m[3] else "op"
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return [*out, ("end", "")]


def number(c: Column) -> Column:
    return c.cast("double")


def fold(columns: list[Column], start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    out = start
    for c in columns:
        out = merge(out, c)
    return out


def divided(a: Column, b: Column, zero: str) -> Column:
    a, b = number(a), number(b)
    if zero == "error":
        return a / b
    if zero == "null":
        return F.try_divide(a, b)
    inf = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding half away from zero."""
    return F.round(number(x), digits)


def average(xs: tuple[Column, ...]) -> Column:
    """Mean of those that are not null; 0 of none."""
    n = fold([F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in xs], F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.try_divide(fold([F.coalesce(number(x), F.lit(0.0)) for x in xs], F.lit(0.0), lambda a, b: a + b), n), F.lit(0.0))


def softmax(values: Column) -> Column:
    """Shares of the exponentials of an array, shifted by the greatest."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def flag(c: Column) -> Column:
    """c, marked as boolean for truth()."""
    c.__dict__["_is_flag"] = True
    return c


def truth(c: Column) -> Column:
    """Booleans as they are; numbers are true unless 0."""
    return c if c.__dict__.get("_is_flag") else number(c) != 0


#: Functions of all dialects.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": lambda x: F.abs(number(x)),
    "ceil": lambda x: F.ceil(number(x)).cast("double"),
    "floor": lambda x: F.floor(number(x)).cast("double"),
    "round": lambda x: half_up(x),
    "sqrt": lambda x: F.sqrt(number(x)),
    "pow": lambda x, y: F.pow(number(x), number(y)),
    "log": lambda x: F.ln(number(x)),
    "log10": lambda x: F.log10(number(x)),
    "exp": lambda x: F.exp(number(x)),
    "min": lambda *xs: F.least(*map(number, xs)) if len(xs) > 1 else number(xs[0]),
    "max": lambda *xs: F.greatest(*map(number, xs)) if len(xs) > 1 else number(xs[0]),
    "sum": lambda *xs: fold([F.coalesce(number(x), F.lit(0.0)) for x in xs], F.lit(0.0), lambda a, b: a + b),
    "avg": lambda *xs: average(xs),
    "count": lambda *xs: fold([F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in xs], F.lit(0.0), lambda a, b: a + b),
    "len": lambda s: F.octet_length(s).cast("double"),
    "lower": F.lower,
    "upper": F.upper,
    "concat": lambda *xs: F.concat_ws("", *[x.cast("string") for x in xs]),
    "substr": lambda s, start, n=None: F.substring(s, start.cast("int") + 1, n.cast("int") if n is not None else F.length(s)),
    "contains": lambda s, x: F.contains(s, x),
    "if": lambda c, a, b: F.when(truth(c), a).otherwise(b),
    "coalesce": lambda *xs: F.coalesce(*xs),
    "float": lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)),
    "int": lambda x: F.coalesce(F.when(x.try_cast("double") < 0, F.ceil(x.try_cast("double"))).otherwise(F.floor(x.try_cast("double"))), F.lit(0)),
    "str": lambda x: x.cast("string"),
    "bool": lambda x: F.when(F.lower(x.cast("string")).isin("true", "1", "1.0", "yes"), 1.0).otherwise(0.0),
    "zscore": lambda v, m, s: F.when(number(s) == 0, 0.0).otherwise(F.try_divide(number(v) - number(m), number(s))),
    "normalize": lambda v, lo, hi: F.when(number(hi) == number(lo), 0.5).otherwise(F.try_divide(number(v) - number(lo), number(hi) - number(lo))),
    "clip": lambda v, lo, hi: F.least(F.greatest(number(v), number(lo)), number(hi)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-number(x))),
    "softmax": lambda *xs: softmax(F.array(*map(number, xs))),
}

#: Functions that a dialect has instead; None removes one. "zero" is its division by zero.
DIALECTS: dict[str, dict] = {
    "expr": {"zero": "inf", "functions": {}},
    "compute": {"zero": "error", "functions": {"if_then_else": FUNCTIONS["if"], "len": lambda s: F.length(s).cast("double")}},
    "pushdown": {"zero": "error", "functions": {"coalesce": lambda *xs: F.coalesce(*[F.nullif(number(x), F.lit(0.0)) for x in xs], F.lit(0.0))}},
    "script": {"zero": "error", "functions": {}},
    "template": {"zero": "null", "functions": {}},
}

#: Functions that callers add, by name.
CUSTOM: dict[str, Callable[..., Column]] = {}


def register(name: str, build: Callable[..., Column]) -> None:
    """Add a function: build gets its arguments as Columns."""
    CUSTOM[name] = build


class Parser:
    def __init__(self, text: str, dialect: str = "expr"):
        self.tokens, self.at, self.dialect = tokens(text), 0, DIALECTS[dialect]
        self.functions = {**FUNCTIONS, **self.dialect["functions"], **CUSTOM}

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] in ("op", "name") else ""

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if value is not None and token[1] != value or token[0] == "end":
            raise ExpressionError(f"expected {value or 'more'}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def parse(self) -> Column:
        out = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def ternary(self) -> Column:
        test = self.binary(1)
        if self.peek() != "?":
            return test
        self.take("?")
        a = self.ternary()
        self.take(":")
        return F.when(truth(test), a).otherwise(self.ternary())

    def binary(self, least: int) -> Column:
        left = self.unary()
        while (op := self.peek()) in BINARY and BINARY[op] >= least:
            self.take()
            left = self.apply(op, left, self.binary(BINARY[op] + 1))
        return left

    def apply(self, op: str, a: Column, b: Column) -> Column:
        if op in ("||", "or"):
            return flag(truth(a) | truth(b))
        if op in ("&&", "and"):
            return flag(truth(a) & truth(b))
        if op == "/":
            return divided(a, b, self.dialect["zero"])
        if op == "%":
            return F.when(number(b) != 0, F.try_mod(number(a), number(b)))
        tests = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}
        if op in tests:
            return flag(tests[op]())
        return {"+": lambda: number(a) + number(b), "-": lambda: number(a) - number(b), "*": lambda: number(a) * number(b)}[op]()

    def unary(self) -> Column:
        if self.peek() == "-":
            self.take()
            return -number(self.unary())
        if self.peek() in ("!", "not"):
            self.take()
            return flag(~truth(self.unary()))
        return self.postfix(self.primary())

    def postfix(self, c: Column) -> Column:
        while self.peek() in ("[", "."):
            if self.take()[1] == ".":
                c = c.getField(self.take()[1])
                continue
            kind, value = self.tokens[self.at]
            index = self.ternary()
            self.take("]")
            c = F.try_element_at(c, index) if kind == "string" else F.get(c, index.cast("int"))
        return c

    def primary(self) -> Column:
        kind, value = self.take()
        if kind == "number":
            return F.lit(float(value))
        if kind == "string":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if value == "(":
            out = self.ternary()
            self.take(")")
            return out
        if kind == "name":
            if value in ("true", "false"):
                return flag(F.lit(value == "true"))
            if value in ("null", "nil"):
                return F.lit(None)
            if self.peek() == "(":
                return self.call(value)
            return F.col(value.lstrip("$"))
        raise ExpressionError(f"unexpected {value!r}")

    def call(self, name: str) -> Column:
        if name not in self.functions:
            raise ExpressionError(f"no function {name!r}")
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.ternary())
            if self.peek() == ",":
                self.take()
        self.take(")")
        try:
            return self.functions[name](*args)
        except TypeError as e:
            raise ExpressionError(f"{name}: {e}") from e


def compiled(text: str, dialect: str = "expr") -> Column:
    """The Column of an expression."""
    return Parser(text, dialect).parse()
