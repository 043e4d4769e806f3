"""Point, as-of, batch and history lookups; versioned writes; conflict resolution.

A history has rows (entity, feature, value, ts, version). Ties in time go to
the higher version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A request list above this many rows is joined by shuffle, not broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def latest(history: DataFrame) -> DataFrame:
    """Current value of each entity and feature."""
    newest = F.struct("ts", "version")
    return history.groupBy("entity", "feature").agg(F.max_by("value", newest).alias("value"), F.max("ts").alias("ts"))


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """Current values at an instant, rows at that very instant included."""
    return latest(history.filter(F.col("ts") <= at))


def batch(history: DataFrame, entities: DataFrame, names: list[str]) -> DataFrame:
    """One row for each requested entity with a column for each requested feature, null where missing."""
    wanted = latest(history.filter(F.col("feature").isin(names)).join(small(entities), "entity", "left_semi"))
    found = wanted.groupBy("entity").pivot("feature", names).agg(F.first("value"))
    return entities.join(found, "entity", "left")


def entity_history(history: DataFrame, entity: object, at: Column) -> DataFrame:
    """All rows of an entity up to an instant, newest first."""
    return history.filter((F.col("entity") == F.lit(entity)) & (F.col("ts") <= at)).orderBy(F.col("ts").desc(), F.col("version").desc())


def put(history: DataFrame) -> DataFrame:
    """The row that stands after all writes: the highest version, of equal ones the first written."""
    w = Window.partitionBy("entity", "feature").orderBy(F.col("version").desc(), F.col("ts").asc())
    return history.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def unexpired(current: DataFrame, at: Column, ttl_seconds: dict[str, int]) -> DataFrame:
    """Rows whose feature's own time to live has not passed; features without one stay."""
    ttl = F.lit(None).cast("long")
    for name, seconds in ttl_seconds.items():
        ttl = F.when(F.col("feature") == name, F.lit(seconds)).otherwise(ttl)
    return current.filter(ttl.isNull() | (F.unix_micros("ts") >= F.unix_micros(at) - ttl * 1_000_000))


def without_entities(history: DataFrame, entities: DataFrame) -> DataFrame:
    return history.join(entities, "entity", "left_anti")


def resolved(source: DataFrame, target: DataFrame, strategy: str) -> DataFrame:
    """Both sides' (entity, value, ts, version) made one: latest (tie to target), source, target, higher_version (tie to latest)."""
    s, t = (df.select("entity", F.struct("value", "ts", "version").alias(n)) for df, n in ((source, "s"), (target, "t")))
    newer = F.when(F.col("s.ts") > F.col("t.ts"), F.col("s")).otherwise(F.col("t"))
    choice = {"latest": newer, "source": F.col("s"), "target": F.col("t"), "higher_version": F.when(F.col("s.version") > F.col("t.version"), F.col("s")).when(F.col("s.version") < F.col("t.version"), F.col("t")).otherwise(newer)}[strategy]
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    one = F.when(both, choice).otherwise(F.coalesce("s", "t"))
    return s.join(t, "entity", "full").select("entity", one.alias("r")).select("entity", "r.value", "r.ts", "r.version")
