"""Scalar feature functions as Columns: strings, time, casts, templates, hashing, JSON."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Layout letters of the time formatter and Spark's, longest first.
LAYOUT = (("2006", "yyyy"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("04", "mm"), ("05", "ss"))


def trimmed(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def formatted(ts: Column, layout: str) -> Column:
    for a, b in LAYOUT:
        layout = layout.replace(a, b)
    return F.date_format(ts, layout)


def weekday(ts: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(ts) - 1


def age_seconds(ts: Column, at: Column) -> Column:
    return (F.unix_micros(at) - F.unix_micros(ts)) / 1_000_000


def rounded(x: Column, digits: int) -> Column:
    """SQL's ROUND of a double: scaled in binary, rounded half away from zero and scaled back; what is not finite stays.

    F.round rounds the shortest decimal instead, which differs where the scaled double is just beside a half.
    """
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x)


def truthy(s: Column) -> Column:
    return F.lower(s.cast("string")).isin("true", "1", "yes")


def hash_share(key: Column, salt: str) -> Column:
    """Place of a key in 0 to 1: the first 8 bytes of SHA-256(key + salt) as an integer over 2**64 - 1."""
    digest = F.substring(F.sha2(F.concat(key.cast("string"), F.lit(salt)), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(1.8446744073709552e19)


def variant(key: Column, salt: str, shares: list[tuple[str, float]]) -> Column:
    """Variant of a key by cumulative shares."""
    at, out, total = hash_share(key, salt), None, 0.0
    for name, share in shares[:-1]:
        total += share
        out = F.when(at < total, name) if out is None else out.when(at < total, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def one_hot(c: Column, values: list[str]) -> dict[str, Column]:
    return {v: (c == v).cast("int") for v in values}


def bucket(c: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value."""
    return sum(((c >= e).cast("int") for e in edges[1:]), (c >= edges[0]).cast("int"))


def min_max(c: Column) -> Column:
    """Scaled to 0..1 over all rows; 0.5 if they are equal."""
    w = Window.partitionBy()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, 0.5).otherwise(F.try_divide(c - lo, hi - lo))


def coerced(c: Column, kind: str) -> Column:
    """c as a feature type: int64, float64, string, bool, bytes, vector, timestamp; null where it has no such value."""
    spark = {"int64": "long", "float64": "double", "string": "string", "bool": "boolean", "bytes": "binary", "vector": "array<float>", "timestamp": "timestamp"}[kind.lower()]
    return c.cast(spark) if spark in ("binary", "array<float>") else c.try_cast(spark)
