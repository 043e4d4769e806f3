"""Predicates, routing, value validation and field transforms, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIASES = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", "neq": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


def predicate(field: str, op: str, value: object) -> Column:
    """One comparison; a null field passes none, and unknown operators pass nothing."""
    c, op = F.col(field), ALIASES.get(op, op)
    ops = {
        "eq": lambda: c == F.lit(value),
        "ne": lambda: c != F.lit(value),
        "gt": lambda: c > F.lit(value),
        "gte": lambda: c >= F.lit(value),
        "lt": lambda: c < F.lit(value),
        "lte": lambda: c <= F.lit(value),
        "in": lambda: c.isin(value),
        "not_in": lambda: ~c.isin(value),
        "contains": lambda: c.contains(value),
        "starts_with": lambda: c.startswith(value),
        "ends_with": lambda: c.endswith(value),
        "regex": lambda: c.rlike(value),
        "not_null": lambda: c.isNotNull(),
    }
    return ops[op]() if op in ops else F.lit(False)


def condition(tree: tuple) -> Column:
    """A tree of ("and" | "or", ...), ("not", x) and (field, op, value)."""
    head, *rest = tree
    if head in ("and", "or") and rest and isinstance(rest[0], tuple):
        out = condition(rest[0])
        for x in rest[1:]:
            out = out & condition(x) if head == "and" else out | condition(x)
        return out
    if head == "not" and isinstance(rest[0], tuple):
        return ~condition(rest[0])
    return predicate(*tree)


def scan(df: DataFrame, columns: list[str], rules: list[tuple]) -> DataFrame:
    """Rows that pass all rules, some columns; both reach the Parquet scan."""
    for rule in rules:
        df = df.filter(predicate(*rule))
    return df.select(columns)


def subscribed(history: DataFrame, names: list[str] | None = None, entities: list | None = None) -> DataFrame:
    """Updates that a subscription with these filters gets; an empty filter passes all."""
    out = history.filter(F.col("feature").isin(names)) if names else history
    return out.filter(F.col("entity").isin(entities)) if entities else out


def route(routes: list[tuple[str, object, str]], default: str) -> Column:
    """Name of the first route whose field equals its value."""
    out = None
    for field, value, name in routes:
        test = F.col(field) == F.lit(value)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)


def first_passing(fields: list[str], op: str, value: object) -> Column:
    """First of the fields, in this order, that passes; else null."""
    return F.coalesce(*[F.when(predicate(f, op, value), F.col(f)) for f in fields])


def violations(specs: dict[str, dict]) -> Column:
    """Names (field:rule) of the rules that a row breaks: min, max, not_null, one_of, regex."""
    found = []
    for field, spec in specs.items():
        c = F.col(field)
        tests = {"min": lambda v: c < v, "max": lambda v: c > v, "not_null": lambda v: c.isNull() if v else F.lit(False), "one_of": lambda v: ~c.isin(v), "regex": lambda v: ~c.cast("string").rlike(v)}
        found += [F.when(F.coalesce(tests[rule](value), F.lit(False)), F.lit(f"{field}:{rule}")) for rule, value in spec.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def by_metadata(df: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    for k, v in wanted.items():
        df = df.filter(F.col(column)[k] == v)
    return df


def transformed(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """Field transforms in order: rename, copy, delete, cast, extract (group 1 of a pattern), default, concat, split, compute."""
    for op, *a in steps:
        if op == "rename":
            df = df.withColumnRenamed(*a)
        elif op == "copy":
            df = df.withColumn(a[1], F.col(a[0]))
        elif op == "delete":
            df = df.drop(a[0])
        elif op == "cast":
            df = df.withColumn(a[0], F.col(a[0]).try_cast(a[1]))
        elif op == "extract":
            df = df.withColumn(a[1], F.regexp_extract(a[0], a[2], 1))
        elif op == "default":
            df = df.withColumn(a[0], F.coalesce(F.col(a[0]), F.lit(a[1])))
        elif op == "concat":
            df = df.withColumn(a[0], F.concat_ws(a[2], *[F.col(c).cast("string") for c in a[1]]))
        elif op == "split":
            df = df.withColumn(a[1], F.split(a[0], a[2]))
        elif op == "compute":
            df = df.withColumn(a[0], F.expr(a[1]))
        else:
            raise ValueError(f"unknown transform {op}")
    return df
