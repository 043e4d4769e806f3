"""Temporal joins: as-of (point in time), within a tolerance, and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_in_time(spine: DataFrame, history: DataFrame, keys: list[str], values: list[str], look_back_seconds: int | None = None, how: str = "inner", ts: str = "ts", tie: list[str] | None = None, band_seconds: int | None = None) -> DataFrame:
    """For each spine row the last history row of its key with ts at or before its own.

    Both sides are sorted together once per key (one shuffle, no row is
    multiplied): history rows come before spine rows of the same instant. Where
    one key may have a large part of the rows, band_seconds cuts time into
    bands: the sort is per key and band, and the last row of earlier bands, found
    over one row for each key and band, comes before all others, at the cost of
    three small shuffles. Values older than the look-back are void;
    how="inner" then drops the row. tie orders history rows of one instant, the
    last wins. Null keys equal each other; null instants match nothing.
    """
    tie = tie or []
    band = (F.floor(F.unix_micros(ts) / (band_seconds * 1_000_000)) if band_seconds else F.lit(0)).alias("_band")
    found = F.struct(F.col(ts).alias("feature_ts"), *values)
    order = F.struct(ts, *[F.col(c).alias(f"_tie_{c}") for c in tie])
    row = F.struct(*[c for c in spine.columns if c not in (*keys, ts)] or [F.lit(0).alias("_")])
    untied = F.struct(ts, *[F.lit(None).cast(history.schema[c].dataType).alias(f"_tie_{c}") for c in tie])
    left = spine.select(*keys, band, untied.alias("_order"), F.lit(2).alias("_side"), row.alias("_row"))
    right = history.filter(F.col(ts).isNotNull()).select(*keys, band, order.alias("_order"), F.lit(1).alias("_side"), found.alias("_found"))
    both = left.unionByName(right, allowMissingColumns=True)
    if band_seconds:
        both = both.unionByName(_carried(left, right, keys), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_band").orderBy(F.col(f"_order.{ts}"), "_side", *[F.col(f"_order._tie_{c}") for c in tie]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_found", ignorenulls=True).over(w)).filter("_side = 2")
    if look_back_seconds is not None:
        fresh = F.unix_micros(F.col("_last.feature_ts")) >= F.unix_micros(F.col(f"_order.{ts}")) - look_back_seconds * 1_000_000
        out = out.withColumn("_last", F.when(fresh, F.col("_last")))
    if how == "inner":
        out = out.filter(F.col("_last").isNotNull())
    names = [c for c in left.schema["_row"].dataType.names if c != "_"]
    return out.select(*keys, F.col(f"_order.{ts}").alias(ts), *[F.col(f"_row.{c}") for c in names], "_last.feature_ts", *[F.col(f"_last.{c}").alias(c) for c in values])


def _carried(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and band of left the last row of right in an earlier band, as a row that sorts before all others (_side 0, no _order)."""
    lasts = right.groupBy(*keys, "_band").agg(F.max_by("_found", "_order").alias("_found"))
    asked = left.filter(F.col("_band").isNotNull()).select(*keys, "_band").distinct().withColumn("_asked", F.lit(True))
    bands = asked.unionByName(lasts, allowMissingColumns=True).groupBy(*keys, "_band").agg(F.max("_asked").alias("_asked"), F.first("_found", ignorenulls=True).alias("_found"))
    past = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    found = bands.withColumn("_found", F.last("_found", ignorenulls=True).over(past)).filter(F.col("_asked") & F.col("_found").isNotNull())
    return found.select(*keys, "_band", F.lit(0).alias("_side"), "_found")


def within(left: DataFrame, right: DataFrame, key: str, seconds: float, how: str = "inner", ts: str = "ts") -> DataFrame:
    """Pairs of equal key whose instants differ by at most so much; left columns get left_, right ones right_.

    Time is cut into bands as wide as the tolerance, so that the join is an
    equality on key and band: a right row stands in its own band and both
    neighbours. A hot key is thereby spread over its bands.
    """
    width = int(seconds * 1_000_000)
    band = lambda c: F.floor(F.unix_micros(c) / F.lit(max(width, 1)))
    a = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns]).withColumn("_k", F.col(f"left_{key}")).withColumn("_band", band(f"left_{ts}"))
    b = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withColumn("_k", F.col(f"right_{key}"))
    near = F.abs(F.unix_micros(f"left_{ts}") - F.unix_micros(f"right_{ts}")) <= width
    spread = b.withColumn("_band", F.explode(F.array(*[band(f"right_{ts}") + d for d in (-1, 0, 1)])))
    pairs = a.join(spread, ["_k", "_band"]).filter(near).drop("_k", "_band")
    if how == "inner":
        return pairs
    out = pairs
    if how in ("left", "full"):
        rest = a.drop("_band").withColumnRenamed("_k", "_ka").join(_matched(a, spread, near, "left_", left.columns), [f"left_{c}" for c in left.columns], "left_anti").drop("_ka")
        out = out.unionByName(rest, allowMissingColumns=True)
    if how in ("right", "full"):
        rest = b.drop("_k").join(_matched(a, spread, near, "right_", right.columns), [f"right_{c}" for c in right.columns], "left_anti")
        out = out.unionByName(rest, allowMissingColumns=True)
    return out


def _matched(a: DataFrame, spread: DataFrame, near: Column, prefix: str, columns: list[str]) -> DataFrame:
    return a.join(spread, ["_k", "_band"]).filter(near).select(*[f"{prefix}{c}" for c in columns]).distinct()


def any_within(left: DataFrame, right: DataFrame, key: str, seconds: float, how: str = "inner", ts: str = "ts") -> DataFrame:
    """Keys of both sides, joined if any pair of their rows is near enough; n_left and n_right rows each."""
    hit = within(left.select(key, ts), right.select(key, ts), key, seconds).select(F.col(f"left_{key}").alias(key)).distinct().withColumn("matched", F.lit(True))
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    both = n(left, "n_left").join(n(right, "n_right"), key, "full").join(hit, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    keep = {"inner": F.col("matched"), "left": F.col("n_left").isNotNull(), "right": F.col("n_right").isNotNull(), "full": F.lit(True)}[how]
    return both.filter(keep)


def training_set(history: DataFrame, label: DataFrame, keys: list[str], values: list[str], look_back_seconds: int) -> DataFrame:
    """The last label row of each key, joined as of its instant."""
    last = label.groupBy(*keys).agg(F.max("ts").alias("ts"))
    return point_in_time(last, history, keys, values, look_back_seconds)


def reconciled(online: DataFrame, offline: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Status of each key: match, mismatch, online_only, offline_only."""
    a, b = online.withColumnRenamed("value", "online"), offline.withColumnRenamed("value", "offline")
    status = F.when(F.col("offline").isNull(), "online_only").when(F.col("online").isNull(), "offline_only").when(F.abs(F.col("online") - F.col("offline")) <= tolerance, "match").otherwise("mismatch")
    return a.join(b, keys, "full").withColumn("status", status)
