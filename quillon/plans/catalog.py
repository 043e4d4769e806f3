"""Facades over histories: a field resolver, view:feature references, and declared streams."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookups, windows
from . import streamsql

CALL = re.compile(r"\{\s*(\w+)\s*\((.*?)\)\s*\}\s*$", re.S)


def resolve(history: DataFrame, text: str) -> DataFrame:
    """``{ feature(name: x, entities: [..]) }``, ``{ history(name: x, entity: e) }`` or ``{ aggregation(name: x, function: sum) }``."""
    m = CALL.match(text.strip())
    if not m:
        raise ValueError(f"cannot read {text!r}")
    args = {k: v.strip().strip('"') for k, v in re.findall(r"(\w+)\s*:\s*(\[[^\]]*\]|[^,\]]+)", m[2])}
    rows = history.filter(F.col("feature") == args["name"])
    if m[1] == "feature":
        if "entities" in args:
            rows = rows.filter(F.col("entity").cast("string").isin([e.strip().strip('"') for e in args["entities"].strip("[]").split(",")]))
        return lookups.latest(rows)
    if m[1] == "history":
        return rows.filter(F.col("entity").cast("string") == args["entity"]).orderBy(F.col("ts").desc())
    if m[1] == "aggregation":
        return rows.groupBy("entity").agg(windows.aggregate(args["function"], "value").alias("value"))
    raise ValueError(f"no field {m[1]!r}")


def online(history: DataFrame, entities: DataFrame, references: list[str]) -> DataFrame:
    """Current values of ``view:feature`` references for each entity."""
    names = [r.split(":", 1)[1] for r in references]
    return lookups.batch(history, entities, names)


CREATE = re.compile(r"CREATE\s+STREAM\s+(\w+)\s*\((.*)\)\s*(?:WITH\s*\((.*)\))?\s*$", re.I | re.S)
WATERMARK = re.compile(r",?\s*WATERMARK\s+FOR\s+(\w+)\s+AS\s+'([^']+)'", re.I)


@dataclass
class Streams:
    """Declared streams and the statements that run on them: CREATE STREAM, DROP STREAM, SELECT."""

    sources: dict[str, DataFrame] = field(default_factory=dict)
    declared: dict[str, DataFrame] = field(default_factory=dict)

    def run(self, sql: str) -> tuple[str, DataFrame | None]:
        """Output mode (update for EMIT CHANGES, append for FINAL, "" without rows) and rows of a statement."""
        if m := CREATE.match(sql.strip().rstrip(";")):
            columns, mark = m[2], WATERMARK.search(m[2])
            df = self.sources[m[1]].select(*[F.col(c.split()[0]).cast(c.split(None, 1)[1]) for c in map(str.strip, WATERMARK.sub("", columns).split(",")) if c])
            self.declared[m[1]] = df.withWatermark(mark[1], streamsql.duration(mark[2])) if mark else df
            return "", None
        if m := re.match(r"DROP\s+STREAM\s+(\w+)", sql.strip(), re.I):
            del self.declared[m[1]]
            return "", None
        return ("update" if streamsql.parse(sql).emit == "CHANGES" else "append"), streamsql.execute(sql, self.declared)
