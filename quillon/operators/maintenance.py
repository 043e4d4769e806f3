"""Materialisation by intervals, partial recomputation, audit digests."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed


def intervals(start: str, end: str, seconds: int) -> list[tuple[datetime, datetime]]:
    a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
    out = []
    while a < b:
        out.append((a, min(a + timedelta(seconds=seconds), b)))
        a = out[-1][1]
    return out


def backfilled(rows: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str, start: str, end: str, seconds: int, path: str) -> None:
    """build of each interval's rows in a folder of its own (interval=...), so that a run that failed can be repeated for the rest."""
    for a, b in intervals(start, end, seconds):
        part = rows.filter((F.col(ts) >= F.lit(a.isoformat(" ")).cast("timestamp")) & (F.col(ts) < F.lit(b.isoformat(" ")).cast("timestamp")))
        build(part).write.mode("overwrite").parquet(f"{path}/interval={a:%Y%m%dT%H%M%S}")


def recomputed(old: DataFrame, rows: DataFrame, dirty: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """old with the results of dirty keys (a DataFrame of them) computed again from rows."""
    return old.join(dirty, key, "left_anti").unionByName(build(rows.join(dirty, key, "left_semi")))


def merkle_root(events: DataFrame, order: str, body: str) -> DataFrame:
    """One row: n and root (hex). Leaves are the SHA-256 of each body in order of a dense integer key; a node is that of its two children's bytes, an odd one's of its own twice, until one is left."""
    n = events.count()
    least = events.agg(F.min(order)).first()[0] or 0
    level = events.select((F.col(order) - least).cast("long").alias("i"), F.unhex(F.sha2(F.col(body), 256)).alias("d"))
    left = n
    while left > 1:
        # children of a node lie side by side: their nodes are made in runs of one partition for as long as there are many
        pair = F.array_sort(F.collect_list(F.struct("i", "d")))
        both = F.concat(pair[0]["d"], F.coalesce(F.get(pair, F.lit(1))["d"], pair[0]["d"]))
        level = level.groupBy(F.expr("i div 2").alias("i")).agg(F.unhex(F.sha2(both, 256)).alias("d"))
        left = (left + 1) // 2
        level = checkpointed(level)
    return level.select(F.lit(n).cast("long").alias("n"), F.lower(F.hex("d")).alias("root"))
