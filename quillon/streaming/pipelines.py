"""Streaming pipelines: file and Kafka sources, windows, joins, late data, change streams, views."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path


def checkpoint_path(spark: SparkSession) -> str:
    """A new folder for a query's state, under the shared folder."""
    return new_path(spark, "stream")


def events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4) -> DataFrame:
    """The events table as a stream of features with instants."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet")
    path = f"{sf_dir}/events.parquet"
    try:
        raw = raw.parquet(path) if not path.endswith(".parquet") or _is_folder(spark, path) else raw.option("pathGlobFilter", os.path.basename(path)).parquet(sf_dir)
    except ValueError:
        raw = raw.parquet(path)
    return raw.select(F.col("user_id").alias("entity"), F.col("event_type").alias("feature"), "value", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("version"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def kafka(spark: SparkSession, servers: str, topic: str, schema: str, starting: str = "latest", starting_timestamp_ms: int | None = None) -> DataFrame:
    """A topic of JSON messages as a stream; needs Spark's Kafka package on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    r = r.option("startingTimestamp", starting_timestamp_ms) if starting_timestamp_ms is not None else r.option("startingOffsets", starting)
    return r.load().select(F.from_json(F.col("value").cast("string"), schema).alias("m"), "timestamp").select("m.*", F.col("timestamp").alias("kafka_ts"))


def windowed(stream: DataFrame, size: str, keys: list[str], lateness: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of each window, behind a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", lateness).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "s")


def sessions(stream: DataFrame, gap: str, keys: list[str], lateness: str) -> DataFrame:
    out = stream.withWatermark("ts", lateness).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "s")


def joined(left: DataFrame, right: DataFrame, key: str, seconds: int, how: str = "inner", lateness: str = "10 minutes") -> DataFrame:
    """Stream-stream join of equal keys whose instants differ by at most so much; outer rows come once they cannot match any more."""
    a = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns]).withWatermark("left_ts", lateness)
    b = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withWatermark("right_ts", lateness)
    span = F.expr(f"right_ts >= left_ts - interval {seconds} seconds and right_ts <= left_ts + interval {seconds} seconds")
    return a.join(b, (F.col(f"left_{key}") == F.col(f"right_{key}")) & span, {"left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}.get(how, how))


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream yields until its input is used up, as a table in the shared folder.

    In mode append the rows go to a file sink; in mode complete each batch
    replaces the one before it: a folder for each, the last of which is read.
    """
    path = new_path(spark, "result")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_path(spark)).trigger(availableNow=True)
    last = []

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    q = (out.foreachBatch(replace) if mode == "complete" else out.format("parquet").option("path", path)).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if mode == "complete":
        path = f"{path}/batch={last[0]}" if last else path
        return spark.read.schema(stream.schema).parquet(path) if last else spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(path)


def routed(stream: DataFrame, routes: dict[str, str], sinks: dict[str, Callable[[DataFrame, int], None]], spark: SparkSession):
    """Each micro-batch goes to every sink whose condition (SQL) a row meets; a sink gets the batch number, so that a repeated batch can be recognised."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, condition in routes.items():
                sinks[name](batch.filter(condition), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path(spark)).trigger(availableNow=True).start()


def envelope(messages: DataFrame, row: str, json_col: str = "json") -> DataFrame:
    """op, lsn and row of change messages: the row after the change, or before it where there is none after."""
    m = F.from_json(json_col, f"op string, lsn long, before struct<{_fields(row)}>, after struct<{_fields(row)}>")
    return messages.select(m.alias("m")).select("m.op", "m.lsn", F.coalesce("m.after", "m.before").alias("row"))


def _fields(row: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in row.split(","))


def applied(changes: DataFrame, keys: list[str], op: str = "op", lsn: str = "lsn") -> DataFrame:
    """Rows that stand after all changes: the one of greatest lsn of each key, unless it deletes."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), lsn).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}") for c in rest]).filter(F.col(op) != "d")


class MaterializedView:
    """A named table of a query's rows: refreshed on demand, or on each micro-batch of a stream."""

    def __init__(self, spark: SparkSession, name: str, build: Callable[[], DataFrame]):
        self.spark, self.name, self.build = spark, name, build
        self.table: DataFrame | None = None

    def refresh(self) -> None:
        old, self.table = self.table, self.build().persist()
        self.table.createOrReplaceTempView(self.name)
        if old is not None:
            old.unpersist()

    def read(self) -> DataFrame:
        if self.table is None:
            self.refresh()
        return self.spark.table(self.name)

    def on_insert(self, stream: DataFrame):
        return stream.writeStream.foreachBatch(lambda batch, number: self.refresh()).option("checkpointLocation", checkpoint_path(self.spark)).trigger(availableNow=True).start()


class Queries:
    """Running streaming queries by name."""

    def __init__(self):
        self.running: dict = {}
        self.submitted: dict[str, Callable] = {}
        self.paused: set[str] = set()
        self.gone: set[str] = set()

    def start(self, name: str, begin: Callable):
        if name in self.running and self.running[name].isActive:
            raise ValueError(f"{name} is running")
        self.running[name] = begin()
        return self.running[name]

    def status(self, name: str) -> str:
        if name in self.paused:
            return "paused"
        q = self.running.get(name)
        if q is None:
            return "pending" if name in self.submitted else "deleted" if name in self.gone else "unknown"
        return "running" if q.isActive else "failed" if q.exception() else "stopped"

    def submit(self, name: str, begin: Callable) -> None:
        """Keeps what starts a query; begin must give it the same checkpoint each time, so that it goes on where it was."""
        if name in self.submitted:
            raise ValueError(f"{name} is submitted")
        self.submitted[name] = begin
        self.gone.discard(name)

    def run(self, name: str):
        """Starts a submitted query, or goes on with a paused or stopped one."""
        self.paused.discard(name)
        return self.start(name, self.submitted[name])

    def pause(self, name: str) -> None:
        """Stops the query; its state stays in the checkpoint, and run() goes on from there."""
        self.running[name].stop()
        self.paused.add(name)

    def stop(self, name: str) -> None:
        self.paused.discard(name)
        self.running[name].stop()

    def delete(self, name: str) -> None:
        """Stops and forgets a query."""
        if name in self.running:
            self.running.pop(name).stop()
        self.submitted.pop(name, None)
        self.paused.discard(name)
        self.gone.add(name)
