"""Input tables as DataFrames with the engine's types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir; wall-clock timestamps become instants (the session's zone is UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a history of features: entity, feature, value, ts, version."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("feature"), "value", "ts", F.col("event_id").alias("version"))


def as_of(text: str):
    """A constant instant."""
    return F.lit(text).cast("timestamp")


def micros(column) -> "F.Column":
    """Instants as microseconds, which compare alike in every engine."""
    return F.unix_micros(column)
