"""Routing by a hash ring, and merges of replicas."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(text: Column) -> Column:
    """Where a key stands on the ring: the first 13 hex digits of its md5."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 13), 16, 10).cast("long")


def ring(nodes: list[str], points: int = 16) -> list[tuple[int, str]]:
    """Places of each node's points, in order."""
    return sorted((int(hashlib.md5(f"{n}#{k}".encode()).hexdigest()[:13], 16), n) for n in nodes for k in range(points))


def owners(key: Column, nodes: list[str], replicas: int = 3, points: int = 16) -> Column:
    """The first different nodes from the key's place on around the ring; for each gap between points they are known beforehand."""
    at = ring(nodes, points)
    walks = []
    for k in range(len(at)):
        walk = list(dict.fromkeys(n for _, n in at[k:] + at[:k]))[:replicas]
        walks.append(F.struct(F.lit(at[k][0]).alias("p"), F.array(*map(F.lit, walk)).alias("w")))
    gaps = F.array(*walks)
    here = place(key)
    after = F.filter(gaps, lambda g: g["p"] >= here)
    return F.coalesce(F.try_element_at(after, F.lit(1)), F.element_at(gaps, 1)).getField("w")


def quorum_read(replicas: DataFrame, keys: list[str], need: int) -> DataFrame:
    """The newest value (by ts, then version) of each key that so many replicas answer for."""
    rest = [c for c in replicas.columns if c not in (*keys, "replica")]
    out = replicas.groupBy(*keys).agg(F.count_distinct("replica").alias("_n"), F.max_by(F.struct(*rest), F.struct("ts", "version")).alias("_r"))
    return out.filter(F.col("_n") >= need).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def counter(increments: DataFrame, keys: list[str]) -> DataFrame:
    """Value of growing and shrinking counters (replica, up, down): the greatest each replica has told, summed."""
    each = increments.groupBy(*keys, "replica").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    return each.groupBy(*keys).agg(F.sum(F.col("up") - F.col("down")).alias("value"))
