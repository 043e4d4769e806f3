"""Keyed values on object stores: versions appended to buckets of keys, read back by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups

BUCKETS = 16


def bucket(entity: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(entity.cast("string")), F.lit(buckets)).cast("int")


def put(history: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends versions (entity, feature, value, ts, version) to the folders of their keys."""
    rows = history.withColumn("bucket", bucket(F.col("entity"), buckets))
    # a bucket is written by several tasks, as one may hold a hot key
    rows.repartition("bucket", F.pmod(F.xxhash64("version"), F.lit(4))).sortWithinPartitions("entity", "feature", "ts").write.mode("append").partitionBy("bucket").parquet(path)


def _of(spark: SparkSession, path: str, entities: list, buckets: int) -> DataFrame:
    """Rows of some keys: only their folders are read."""
    wanted = spark.createDataFrame([(str(e),) for e in entities], "e string").select(bucket(F.col("e"), buckets).alias("b")).distinct()
    return spark.read.parquet(path).filter(F.col("bucket").isin([r.b for r in wanted.collect()]) & F.col("entity").cast("string").isin([str(e) for e in entities])).drop("bucket")


def get(spark: SparkSession, path: str, entity, names: list[str] | None = None, as_of: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Current values of one key, or those at an instant."""
    return batch_get(spark, path, [entity], names, as_of, buckets)


def batch_get(spark: SparkSession, path: str, entities: list, names: list[str] | None = None, as_of: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    rows = _of(spark, path, entities, buckets)
    rows = rows if names is None else rows.filter(F.col("feature").isin(names))
    return lookups.latest(rows if as_of is None else rows.filter(F.col("ts") <= as_of))
