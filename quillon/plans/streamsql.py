"""A windowed SQL dialect over named DataFrames.

``SELECT list FROM name [AS a] [[LEFT|RIGHT|FULL] JOIN name [AS b] ON x = y] [WHERE ...]
[GROUP BY ...] [WINDOW TUMBLE(ts, '1m') | SLIDE(ts, '5m', '1m') | SESSION(ts, '30s')]
[HAVING ...] [ORDER BY ...] [LIMIT n] [EMIT CHANGES | FINAL]``

A WINDOW clause groups by the window and adds window_start and window_end to
the result. AND binds tighter than OR; join sides are told apart. Everything
inside a clause is Spark SQL's own, so all its functions can be used; the
statement becomes one DataFrame that Catalyst plans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP BY", "WINDOW", "HAVING", "ORDER BY", "LIMIT", "EMIT")
UNITS = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
AGGREGATES = re.compile(r"\b(count|sum|avg|min|max|stddev|stddev_pop|first|last|min_by|max_by|percentile)\s*\(", re.I)


class StatementError(ValueError):
    """A statement that cannot be read."""


def duration(text: str) -> str:
    """'1h30m' and the like as a Spark interval."""
    parts = re.findall(r"(\d+)(ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise StatementError(f"no duration: {text!r}")
    return " ".join(f"{n} {UNITS[u]}" for n, u in parts)


def _pieces(sql: str) -> list[str]:
    """sql cut into strings, parentheses, commas, words and the rest."""
    out = re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|\(|\)|,|[\w.$]+|[^\s\w]", sql)
    if sql.count("'") % 2:
        raise StatementError("a string has no end")
    return out


def clauses(sql: str) -> dict[str, str]:
    """Text of each clause, found outside of parentheses and strings."""
    marks, depth, at = [], 0, 0
    pattern = re.compile(r"'(?:[^']|'')*'|[()]|\b(?:SELECT|FROM|WHERE|GROUP\s+BY|WINDOW|HAVING|ORDER\s+BY|LIMIT|EMIT)\b", re.I)
    _pieces(sql)
    for m in pattern.finditer(sql):
        t = m[0]
        depth += (t == "(") - (t == ")")
        if depth == 0 and t[0] not in "'()":
            marks.append((m.start(), m.end(), re.sub(r"\s+", " ", t.upper())))
    out = {}
    for (_, end, name), nxt in zip(marks, [*marks[1:], (len(sql), 0, "")]):
        if name in out:
            raise StatementError(f"{name} stands twice")
        out[name] = sql[end : nxt[0]].strip().rstrip(";").strip()
        at = end
    if "SELECT" not in out or "FROM" not in out or not at:
        raise StatementError("a statement needs SELECT and FROM")
    return out


def listed(text: str) -> list[str]:
    """Items of a list, split at commas outside of parentheses and strings."""
    out, depth, item = [], 0, ""
    for p in re.findall(r"'(?:[^']|'')*'|[(),]|[^'(),]+", text):
        depth += (p == "(") - (p == ")")
        if p == "," and depth == 0:
            out.append(item.strip())
            item = ""
        else:
            item += p
    return [*out, item.strip()]


@dataclass
class Statement:
    select: list[str]
    source: str
    join: tuple[str, str, str] | None = None
    where: str | None = None
    group_by: list[str] = field(default_factory=list)
    window: tuple[str, str, list[str]] | None = None
    having: str | None = None
    order_by: list[str] = field(default_factory=list)
    limit: int | None = None
    emit: str = "FINAL"


def parse(sql: str) -> Statement:
    c = clauses(sql)
    source, join = c["FROM"], None
    if m := re.match(r"(.+?)\s+((?:LEFT|RIGHT|FULL|INNER|CROSS)?\s*(?:OUTER\s+)?)JOIN\s+(.+?)(?:\s+ON\s+(.+))?$", source, re.I | re.S):
        source, join = m[1], (m[2].strip().split(" ")[0].lower() or "inner", m[3], m[4] or "")
    window = None
    if "WINDOW" in c:
        m = re.match(r"(TUMBLE|TUMBLING|SLIDE|SLIDING|HOP|SESSION)\s*\((.*)\)$", c["WINDOW"], re.I | re.S)
        if not m:
            raise StatementError(f"no window: {c['WINDOW']!r}")
        ts, *sizes = listed(m[2])
        window = (m[1].upper(), ts, [duration(s.strip("'")) for s in sizes])
    if "LIMIT" in c and not c["LIMIT"].isdigit():
        raise StatementError(f"no limit: {c['LIMIT']!r}")
    return Statement(listed(c["SELECT"]), source, join, c.get("WHERE"), listed(c["GROUP BY"]) if c.get("GROUP BY") else [], window, c.get("HAVING"), listed(c["ORDER BY"]) if c.get("ORDER BY") else [], int(c["LIMIT"]) if c.get("LIMIT") else None, c.get("EMIT", "FINAL").upper())


def _named(tables: dict[str, DataFrame], text: str) -> DataFrame:
    m = re.match(r"(\w+)(?:\s+(?:AS\s+)?(\w+))?$", text.strip(), re.I)
    if not m or m[1] not in tables:
        raise StatementError(f"no table {text!r}")
    return tables[m[1]].alias(m[2] or m[1])


def _as(item: str) -> tuple[str, str | None]:
    m = re.match(r"(.+?)\s+AS\s+(\w+)$", item, re.I | re.S)
    return (m[1], m[2]) if m else (item, None)


def execute(sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The statement as a DataFrame over the named tables."""
    s = parse(sql)
    df = _named(tables, s.source)
    if s.join:
        kind, right, on = s.join
        df = df.crossJoin(_named(tables, right)) if kind == "cross" or not on else df.join(_named(tables, right), F.expr(on), kind)
    if s.where:
        df = df.filter(F.expr(s.where))
    aggregates = any(AGGREGATES.search(i) for i in s.select)
    if s.window or s.group_by or aggregates:
        keys = [F.expr(g) for g in s.group_by]
        if s.window:
            kind, ts, sizes = s.window
            w = F.session_window(ts, sizes[0]) if kind == "SESSION" else F.window(ts, *sizes)
            keys.append(w.alias("_w"))
        items = [_as(i) for i in s.select]
        plain = [(e, n) for e, n in items if not AGGREGATES.search(e)]
        aggs = [(e, n or e) for e, n in items if AGGREGATES.search(e)]
        df = df.groupBy(*keys).agg(*[F.expr(e).alias(n) for e, n in aggs]) if aggs else df.groupBy(*keys).agg(F.count("*").alias("_n")).drop("_n")
        out = [F.expr(e.split(".")[-1]).alias(n or e.split(".")[-1]) if e != "*" else F.col("*") for e, n in plain] + [F.col(f"`{n}`") for _, n in aggs]
        if s.window:
            out += [F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")]
        df = df.select(*out)
    elif s.select != ["*"]:
        df = df.select(*[F.expr(e).alias(n) if n else F.expr(e) for e, n in map(_as, s.select)])
    if s.having:
        df = df.filter(F.expr(s.having))
    if s.order_by:
        order = []
        for item in s.order_by:
            m = re.match(r"(.+?)(?:\s+(ASC|DESC))?$", item, re.I | re.S)
            order.append(F.expr(m[1]).desc() if (m[2] or "").upper() == "DESC" else F.expr(m[1]).asc())
        df = df.orderBy(*order)
    return df.limit(s.limit) if s.limit is not None else df


OVER = re.compile(r"OVER\s*\(\s*(PARTITION\s+BY\s+[\w., ]+?)\s+WINDOW\s+'([^']+)'\s*\)", re.I)


def rewritten(sql: str, ts: str = "ts") -> str:
    """``OVER (PARTITION BY k WINDOW '1h')`` as a range frame of Spark SQL."""
    return OVER.sub(lambda m: f"OVER ({m[1]} ORDER BY {ts} RANGE BETWEEN INTERVAL {duration(m[2])} PRECEDING AND CURRENT ROW)", sql)


CREATE = re.compile(r"CREATE\s+FEATURE\s+(\w+)\s+AS\s+(SELECT.+)$", re.I | re.S)


def create_feature(sql: str, tables: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    """Name and DataFrame of ``CREATE FEATURE n AS SELECT ...``."""
    m = CREATE.match(sql.strip())
    if not m:
        raise StatementError("no CREATE FEATURE")
    return m[1], execute(m[2], tables)
