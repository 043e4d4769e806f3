"""What the operators of this subpackage share: tables, checkpoints, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: spark.checkpoint.dir, or what the session was given.

    Only a master on one machine (tests) gets a temporary folder where none is
    set; elsewhere that is an error, as other machines could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read from there."""
    root = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def packed(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs, so that no name of theirs can clash), _id, _h (hash of the text): rows equal in id and text get equal results."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h"))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of _row, but for those changed."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in columns])


def text_slices(column: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about most_bytes of UTF-8; null counts as empty.

    Bounds the arrays that the kernels make to a multiple of most_bytes, or of
    the one text that is longer than that.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


#: Rows of one key are joined with the key's one fact in so many shares.
SALTS = 8


def dealt(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows joined with the one row of facts that has their keys; a key's rows are dealt by the columns by to SALTS tasks, as one key may have most of all rows. Facts grow with the corpus and are not broadcast at any size."""
    each = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(each.hint("merge"), [*keys, "_salt"]).drop("_salt")


#: Has Spark delete a plan's shuffle files as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written as a compressed table in the shared checkpoint folder and read from there.

    Smaller than a checkpoint where there are many rows, and the shuffle files
    that it took are deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discarded(df: DataFrame) -> None:
    """Deletes a table that stored() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
