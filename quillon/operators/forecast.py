"""Forecast accesses from smoothed rates and hours of the day; clusters of entities by their hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed_rates(history: DataFrame, keys: list[str], ts: str, order: list[str], alpha: float = 0.3, unit: float = 1.0) -> DataFrame:
    """keys, rate (exponentially smoothed accesses per unit seconds, 1 at first) and total.

    The fold a * r + (1 - a) * before is written as a weighted sum, so that no
    task holds a key's history. Intervals of no length change no rate.
    """
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    gaps = history.withColumn("_gap", (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)) / (1e6 * unit))
    back = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("_gap") > 0
    terms = gaps.withColumn("_later", F.coalesce(F.count_if(real).over(back), F.lit(0)))
    term = F.when(real, alpha * F.pow(F.lit(1 - alpha), F.col("_later")) / F.col("_gap")).otherwise(0.0)
    return terms.groupBy(*keys).agg((F.pow(F.lit(1 - alpha), F.count_if(real)) + F.sum(term)).alias("rate"), F.count("*").alias("total"))


def forecast(history: DataFrame, keys: list[str], ts: str, order: list[str], hour: int, alpha: float = 0.3, periods: int = 24, at_least: int = 5, unit: float = 1.0) -> DataFrame:
    """keys with predicted (rate times the hour's share of accesses), confidence (by their number) and priority, all to 3 places; keys of fewer than at_least accesses are left out."""
    rates = smoothed_rates(history, keys, ts, order, alpha, unit).filter(F.col("total") >= at_least)
    hours = history.groupBy(*keys).agg(F.count_if(F.hour(ts) == hour).alias("_hour"))
    adjusted = F.col("rate") * F.col("_hour") / (F.col("total") / periods)
    sure = F.least(F.lit(1.0), F.col("total") / (4.0 * at_least))
    return rates.join(hours, keys).select(*keys, F.round(adjusted, 3).alias("predicted"), F.round(sure, 3).alias("confidence"), F.round(adjusted * sure, 3).alias("priority"))


def _nearest(hours: list[Column], centroids: list[list[float]]) -> Column:
    """Number of the nearest centroid, the first of equal ones."""
    far = [sum(((h - F.lit(v)) * (h - F.lit(v)) for h, v in zip(hours, c)), F.lit(0.0)) for c in centroids]
    return F.array_position(F.array(*far), F.array_min(F.array(*far))).cast("int") - 1


def hour_clusters(history: DataFrame, entity: str, ts: str, k: int = 4, rounds: int = 20) -> DataFrame:
    """entity, cluster: k-means of the entities' accesses by hour (unit vectors), from the first k entities.

    Only k centroids of 24 numbers come to the driver; sums are of decimals, so
    that their order changes nothing.
    """
    counts = history.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull()).groupBy(entity).agg(*[F.count_if(F.hour(ts) == h).alias(f"h{h}") for h in range(24)])
    norm = F.sqrt(sum((F.col(f"h{h}") * F.col(f"h{h}") for h in range(24)), F.lit(0)))
    vectors = counts.select(entity, *[(F.col(f"h{h}") / norm).cast("decimal(20,12)").alias(f"h{h}") for h in range(24)])
    hours = [F.col(f"h{h}").cast("double") for h in range(24)]
    centroids = [[float(v) for v in r[1:]] for r in vectors.orderBy(entity).limit(k).collect()]
    if not centroids:
        return vectors.select(entity, F.lit(0).alias("cluster"))
    for n in range(rounds):
        assigned = vectors.select(entity, _nearest(hours, centroids).alias("cluster"))
        if n == rounds - 1:
            break
        means = vectors.groupBy(_nearest(hours, centroids).alias("cluster")).agg(F.count("*").alias("n"), *[F.sum(f"h{h}").alias(f"h{h}") for h in range(24)]).collect()
        # a centroid without members goes to the origin
        new = [[0.0] * 24 for _ in centroids]
        for r in means:
            new[r["cluster"]] = [float(r[f"h{h}"]) / r["n"] for h in range(24)]
        if new == centroids:
            break
        centroids = new
    return assigned
