"""Histograms, top-k, snapshot differences and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def horizontal(fields: list[str]) -> dict[str, Column]:
    """Sum, average, least, greatest and number of a row's fields; nulls are skipped."""
    vs = [F.col(f) for f in fields]
    n = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), 1).otherwise(0) for v in vs])
    s = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in vs])
    return {"s": F.round(s, 6), "a": F.round(F.try_divide(s, n), 6), "lo": F.least(*vs), "hi": F.greatest(*vs), "n": n}


def histogram(df: DataFrame, field: str, bins: int) -> DataFrame:
    """bin and n of equal-width bins from the least to the greatest value; the last bin is closed."""
    bounds = df.agg(F.min(field).alias("_lo"), F.max(field).alias("_hi"))
    # one row is broadcast
    share = F.try_divide(F.col(field) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return df.select(field).crossJoin(F.broadcast(bounds)).groupBy(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or changed."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, change.alias("change"))


def latest_wins(versions: list[DataFrame], keys: list[str], version: str) -> DataFrame:
    """Union of versions with the greatest version of each key."""
    every = reduce(DataFrame.unionByName, versions)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def best(lists: list[DataFrame], key: str, score: str) -> DataFrame:
    return reduce(DataFrame.unionByName, lists).groupBy(key).agg(F.max(score).alias(score))
