"""Event patterns over ordered histories: sequences and windows that start at events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def followed_by(history: DataFrame, key: str, first: str, second: str, seconds: int, kind: str = "feature", ts: str = "ts") -> DataFrame:
    """key, first_ts, second_ts: for every first event the next later second event of its key, if it comes in time.

    One sort per key: the least instant of the second kind among the rows with
    a later instant, so no pair of events is joined.
    """
    later = Window.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col(kind) == second, F.col(ts))).over(later)
    rows = history.filter(F.col(kind).isin(first, second)).withColumn("second_ts", nxt).filter(F.col(kind) == first)
    return rows.filter(F.unix_micros("second_ts") - F.unix_micros(ts) <= seconds * 1_000_000).select(key, F.col(ts).alias("first_ts"), "second_ts")


def first_event_windows(history: DataFrame, key: str, seconds: int) -> DataFrame:
    """key, window_start, n, s: a window opens at the first event after the last one's end.

    Where a window starts depends on the one before it, for which Spark has no
    window; rows sorted by key and instant stream through Arrow batches, and a
    task holds one batch and the open window. Events without an instant are
    left out; null values count, but add nothing; null keys are one key.
    """
    width = seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, start, n, s of the open window
        for batch in batches:
            done = []
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            at = codes.indices.to_numpy(zero_copy_only=False)
            t, x = batch.column(1).to_numpy(), np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                k = codes.dictionary[int(at[lo])].as_py()
                if held and held[0] != k:
                    done.append(held)
                    held = None
                while lo < hi:
                    if held is None:
                        held = (k, int(t[lo]), 0, 0.0)
                    end = lo + int(np.searchsorted(t[lo:hi], held[1] + width))
                    held = (k, held[1], held[2] + end - lo, sum(x[lo:end].tolist(), held[3]))
                    lo = end
                    if lo < hi:
                        done.append(held)
                        held = None
            yield _window_rows(done, key, batch.schema.field(0).type)
        if held:
            yield _window_rows([held], key, batch.schema.field(0).type)

    rows = history.filter(F.col("ts").isNotNull()).select(key, F.unix_micros("ts").alias("t"), F.col("value").cast("double").alias("x"), "version")
    rows = rows.repartition(key).sortWithinPartitions(key, "t", "version").drop("version")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(fold, f"`{key}` {kind}, t long, n long, s double").select(key, F.timestamp_micros("t").alias("window_start"), "n", "s")


def _window_rows(windows: list[tuple], name: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*windows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.int64(), pa.float64()))], names=[name, "t", "n", "s"])


def match_sequences(events: DataFrame, steps: list[str], seconds: int, key: str = "entity", kind: str = "feature"):
    """Streaming sequences by custom state: key, first_ts, last_ts of each run of steps, skipping other events, within a time.

    events is a stream with a watermark on ts. State is one list of partial
    matches for each key; it goes when event time passes its end.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        partial = [tuple(p) for p in state.get[0]] if state.exists else []
        found = []
        rows = pd.concat(list(batches))
        at_all = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        order = at_all.argsort(kind="stable")
        for at, name in zip(at_all[order].tolist(), rows[kind].to_numpy()[order].tolist()):
            after = []
            for step, start, last in partial:
                if at - start > seconds * 1_000_000:
                    continue
                if name == steps[step] and at > last:
                    if step + 1 == len(steps):
                        found.append((k[0], start, at))
                    else:
                        after.append((step + 1, start, at))
                else:
                    after.append((step, start, last))
            if name == steps[0]:
                after.append((1, at, at))
            partial = after
        state.update(([list(p) for p in partial],))
        if state.getCurrentWatermarkMs() >= 0:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + seconds * 1000 + 1)
        out = pd.DataFrame(found, columns=[key, "first_ts", "last_ts"])
        for c in ("first_ts", "last_ts"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us").astype("datetime64[us]").dt.tz_localize("UTC").dt.tz_convert(None)
        yield out

    kind_of = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind_of}, first_ts timestamp, last_ts timestamp", "partial array<array<bigint>>", "append", "EventTimeTimeout")
