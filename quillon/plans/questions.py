"""Questions in plain words by rules: an aggregate, grouping, order and limit become one windowed SQL statement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from . import streamsql

WORDS = {"average": "avg", "mean": "avg", "avg": "avg", "total": "sum", "sum": "sum", "count": "count", "number": "count", "maximum": "max", "highest": "max", "minimum": "min", "lowest": "min"}
QUESTION = re.compile(r"(?:(top|bottom)\s+(\d+)\s+(\w+)\s+by\s+)?(?:the\s+)?(\w+)(?:\s+of)?(?:\s+(?!by\b|per\b|where\b)(\w+))?(?:\s+(?:by|per)\s+(\w+))?(?:\s+where\s+(.+))?$", re.I)


def statement(question: str, table: str) -> str:
    """SQL of a question such as ``average value by event_type`` or ``top 5 user_id by total value``."""
    m = QUESTION.match(question.strip().rstrip("?"))
    if not m or m[4].lower() not in WORDS:
        raise ValueError(f"cannot read {question!r}")
    side, n, entity, word, field, key, where = m.groups()
    key = entity or key
    function = WORDS[word.lower()]
    argument = "*" if function == "count" else field
    if argument is None:
        raise ValueError(f"{word} of what in {question!r}")
    sql = f"SELECT {key + ', ' if key else ''}{function}({argument}) AS answer FROM {table}"
    sql += f" WHERE {where}" if where else ""
    sql += f" GROUP BY {key}" if key else ""
    return sql + (f" ORDER BY answer {'DESC' if side.lower() == 'top' else 'ASC'}, {key} LIMIT {n}" if side else "")


def answered(question: str, table: str, df: DataFrame) -> DataFrame:
    return streamsql.execute(statement(question, table), {table: df})
