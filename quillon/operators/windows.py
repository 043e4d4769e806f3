"""Event-time windows and windowed aggregates over batches or streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weekly windows start on Mondays; Spark's start on Thursdays, the epoch's weekday.
MONDAY = "4 days"


def aggregate(name: str, field: str, order: Column | None = None) -> Column:
    """An aggregate by name: count sum avg min max first last distinct p95 stddev variance (population; 0 for one row)."""
    v, o = F.col(field), order if order is not None else F.col("ts")
    return {
        "count": lambda: F.count(v),
        "sum": lambda: F.sum(v),
        "avg": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "first": lambda: F.min_by(v, o),
        "last": lambda: F.max_by(v, o),
        "distinct": lambda: F.count_distinct(v),
        "p95": lambda: F.percentile(v, F.lit(0.95)),
        "stddev": lambda: F.stddev_pop(v),
        "variance": lambda: F.var_pop(v),
    }[name]()


def tumbling(df: DataFrame, size: str, keys: list[str], aggregates: dict[str, Column], ts: str = "ts", start: str | None = None) -> DataFrame:
    w = F.window(ts, size, size, start) if start else F.window(ts, size)
    return _flat(df.groupBy(*keys, w.alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()]), keys, aggregates)


def sliding(df: DataFrame, size: str, slide: str, keys: list[str], aggregates: dict[str, Column], ts: str = "ts") -> DataFrame:
    return _flat(df.groupBy(*keys, F.window(ts, size, slide).alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()]), keys, aggregates)


def session(df: DataFrame, gap: str, keys: list[str], aggregates: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Sessions of each key; events exactly a gap apart are one session, which ends a gap after its last event."""
    return _flat(df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()]), keys, aggregates)


def _flat(df: DataFrame, keys: list[str], aggregates: dict) -> DataFrame:
    return df.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggregates)


def bucket_width(window_seconds: int, slide_seconds: int | None = None) -> int:
    """Width in seconds of the partial buckets of a sliding aggregate: minute, hour or day, no wider than the slide."""
    width = 60 if window_seconds <= 3600 else 3600 if window_seconds <= 86400 else 86400
    return min(width, slide_seconds or width)


def buckets(history: DataFrame, width: int) -> DataFrame:
    """Partial aggregates of each entity, feature and bucket; merging them gives any longer window."""
    start = F.floor(F.unix_seconds("ts") / width) * width
    return history.groupBy("entity", "feature", start.alias("bucket")).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(F.struct("ts", "version", "value")).alias("last"))


def merged(partials: DataFrame, as_of_seconds: Column, window_seconds: int, slide_seconds: int) -> DataFrame:
    """count sum avg min max last over the buckets from the window's start on; the end is open."""
    since = F.floor(as_of_seconds / slide_seconds) * slide_seconds - window_seconds
    some = partials.filter(F.col("bucket") >= since)
    return some.groupBy("entity", "feature").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), (F.sum("s") / F.sum("n")).alias("avg"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.max("last").getField("value").alias("last"))


def rolling(keys: list[str], seconds: int, ts: str = "ts"):
    """Window of the rows of a key up to so many seconds before each row."""
    return Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)


def late(df: DataFrame, keys: list[str], allowed_seconds: int, order: list[str], ts: str = "ts") -> Column:
    """Whether a row, in arrival order, comes more than so long after the greatest instant before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.unix_micros(ts) < F.max(F.unix_micros(ts)).over(w) - allowed_seconds * 1_000_000, F.lit(False))


def closed(results: DataFrame, now: str, late_seconds: int) -> DataFrame:
    """Windows (window_start, window_end) that are closed at an instant: their end and the lateness lie before it."""
    return results.filter(F.unix_micros("window_end") + late_seconds * 1_000_000 < F.unix_micros(F.lit(now).cast("timestamp")))


def join_watermark(left: DataFrame, right: DataFrame, grace_seconds: float, keys: list[str], ts: str = "ts") -> DataFrame:
    """keys and watermark: the least instant that either side has buffered, less the grace."""
    both = left.select(*keys, ts).unionByName(right.select(*keys, ts))
    return both.groupBy(*keys).agg(F.timestamp_micros(F.min(F.unix_micros(ts)) - int(grace_seconds * 1_000_000)).alias("watermark"))
