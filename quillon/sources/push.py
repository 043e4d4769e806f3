"""Pushed updates: decoding, checks, dead letters, admission, bounded queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPDATE = "entity string, features map<string,double>, ts timestamp"


def key_error(entity: Column) -> Column:
    """Why a key is refused, or null."""
    k = entity.cast("string")
    return (
        F.when(k.isNull() | (k == ""), "empty key")
        .when(F.octet_length(k) > 512, "key above 512 bytes")
        .when(k.rlike(r"[\x00-\x1f\x7f]"), "control character in key")
        .when(k.contains("../"), "path in key")
    )


def checked(updates: DataFrame, most_features: int = 1000) -> DataFrame:
    """updates (entity, features map) with error: why each is refused, or null; a bulk push takes the others."""
    n = F.size("features")
    rest = F.when(F.col("features").isNull() | (n == 0), "no features").when(n > most_features, "too many features").when(F.exists(F.map_keys("features"), lambda x: x == ""), "empty feature name")
    return updates.withColumn("error", F.coalesce(key_error(F.col("entity")), rest))


def decoded(messages: DataFrame, value: str = "value", schema: str = UPDATE) -> DataFrame:
    """Messages (batch or stream) of JSON updates: the update's columns and error; what does not parse is a dead letter, not a failure."""
    m = F.from_json(F.col(value).cast("string"), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = messages.withColumn("_m", m)
    out = checked(out.select(*messages.columns, "_m.*"))
    return out.withColumn("error", F.when(F.col("_bad").isNotNull() | F.col(value).isNull(), "not JSON").otherwise(F.col("error"))).drop("_bad")


def admitted(requests: DataFrame, client: str, ts: str, most: int, order: str) -> DataFrame:
    """requests with admitted: whether each is among its client's first so many in its second."""
    second = Window.partitionBy(client, F.unix_seconds(ts)).orderBy(ts, order)
    return requests.withColumn("admitted", F.row_number().over(second) <= most)


def queued(writes: DataFrame, ts: str, order: str, capacity: int, flush_seconds: int) -> DataFrame:
    """Writes that a queue of a capacity, emptied every flush, takes: the first ones of each interval; the others are dropped."""
    flush = Window.partitionBy(F.floor(F.unix_seconds(ts) / flush_seconds)).orderBy(ts, order)
    return writes.withColumn("_n", F.row_number().over(flush)).filter(F.col("_n") <= capacity).drop("_n")


def upserted(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of batch in the place of those with their keys, and the new ones."""
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(batch)
