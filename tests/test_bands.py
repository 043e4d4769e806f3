"""As-of joins over bands and windows from first events, against plain versions."""

import bisect
import random

from pyspark.sql import functions as F

from quillon.operators import joins
from quillon.streaming import patterns

DAY = 86400


def test_as_of_of_a_hot_key_over_many_bands(spark):
    rng = random.Random(2)
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    history = [(key(), rng.randrange(0, 400 * DAY, 3600), n) for n in range(1500)]
    spine = [(key(), rng.randrange(0, 420 * DAY, 3600), n) for n in range(1500)] + [("hot", None, -1)]
    at = lambda rows, names: spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    h, s = at(history, "k string, t long, v int"), at(spine, "k string, t long, id int")
    sorted_ = {}
    for k, t, v in sorted(history, key=lambda r: (r[1], r[2])):
        sorted_.setdefault(k, []).append((t, v))
    want = {}
    for k, t, n in spine:
        place = bisect.bisect_right(sorted_.get(k, []), (t, float("inf"))) if t is not None else 0
        want[n] = sorted_[k][place - 1][1] if place else None
    for width in (None, DAY, 7 * DAY, 1000 * DAY):
        got = {r.id: r.v for r in joins.point_in_time(s, h, ["k"], ["v"], how="left", tie=["v"], band_seconds=width).collect()}
        assert got == want
    assert {r.id for r in joins.point_in_time(s, h, ["k"], ["v"], tie=["v"]).collect()} == {n for n, v in want.items() if v is not None}
    # the sort that carries values takes key and band, so a hot key's rows are spread
    plan = joins.point_in_time(s, h, ["k"], ["v"], tie=["v"], band_seconds=DAY)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k" in plan and "_band" in plan
    assert joins.point_in_time(s, h.limit(0), ["k"], ["v"], how="left", band_seconds=DAY).filter("v is not null").count() == 0


def test_first_event_windows_across_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 50_000), n, rng.choice([None, 1.5, 2.0])) for n in range(800)] + [("a", None, 900, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, version int, value double").withColumn("ts", F.timestamp_seconds("t"))
    want = []
    for k in ("a", "b", None):
        start = None
        for x, t, _, v in sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (r[1], r[2])):
            if start is None or t >= start + 600:
                want.append([k, t, 0, 0.0])
                start = t
            want[-1][2] += 1
            want[-1][3] += v or 0.0
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = patterns.first_event_windows(df, "k", 600).select("k", F.unix_seconds("window_start"), "n", "s").collect()
            assert sorted(map(repr, map(list, got))) == sorted(map(repr, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert patterns.first_event_windows(df.limit(0), "k", 600).count() == 0
