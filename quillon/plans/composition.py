"""Derived features in dependency order: a small DERIVE language and composition graphs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.expressions import compiled
from ..operators.graphs import levels

DERIVE = re.compile(r"DERIVE\s+(\w+)\s+AS\s+(.+?)(?:\s+FROM\s+([\w\s,]+?))?\s*$", re.I)


def composed(df: DataFrame, nodes: dict[str, str], needs: dict[str, list[str]]) -> DataFrame:
    """df with a column for each node (an expression), one projection for each level of the graph."""
    for level in levels(needs):
        df = df.withColumns({n: compiled(nodes[n], "template") for n in level if n in nodes})
    return df


def derived(df: DataFrame, program: str) -> DataFrame:
    """df with the columns of a program's lines: ``SOURCE a, b`` names inputs, ``DERIVE n AS expression FROM a, b`` columns."""
    nodes, needs, sources = {}, {}, set(df.columns)
    for line in filter(None, map(str.strip, program.splitlines())):
        if line.upper().startswith("SOURCE "):
            missing = {s.strip() for s in line[7:].split(",")} - set(df.columns)
            if missing:
                raise ValueError(f"no source {sorted(missing)}")
        elif m := DERIVE.match(line):
            nodes[m[1]] = m[2]
            needs[m[1]] = [s.strip() for s in (m[3] or "").split(",") if s.strip() and s.strip() not in sources]
        else:
            raise ValueError(f"cannot read {line!r}")
    return composed(df, nodes, needs)


def assigned(df: DataFrame, program: str) -> DataFrame:
    """df with the columns of lines ``name = expression``, each of which may use those above it."""
    for line in filter(None, map(str.strip, program.splitlines())):
        name, eq, text = line.partition("=")
        if not eq or not name.strip().isidentifier():
            raise ValueError(f"cannot read {line!r}")
        df = df.withColumn(name.strip(), compiled(text, "template"))
    return df
