import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillon.functions import statistics
from quillon.functions.registry import Registry
from quillon.sources import files, schemas
from quillon.streaming import patterns, pipelines


def test_csv_features(spark, tmp_path):
    (tmp_path / "a.csv").write_text("entity_key,click_count,purchase_total,flag,vec\nuser:A,10,100.50,true,\"[1, 2]\"\nuser:B,20,200.75,false,x\nuser:C,30,300.00,,\n")
    rows = files.read(spark, str(tmp_path / "a.csv"), "csv")
    assert rows.count() == 3
    long = files.features_of(rows, "entity_key", None, F.lit("2024-01-01").cast("timestamp"))
    assert long.count() == 10
    got = {(r.entity, r.feature): r.s for r in long.withColumn("s", files.sniffed(F.col("value"))).collect()}
    assert got["user:A", "click_count"].int64 == 10 and got["user:A", "purchase_total"].float64 == 100.5 and got["user:A", "flag"].bool is True
    assert got["user:A", "vec"].vector == [1.0, 2.0] and got["user:B", "vec"].text == "x" and got["user:B", "vec"].int64 is None


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_round_trips(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", None, None)], "k string, n long, x double")
    files.write(df, str(tmp_path / fmt), fmt)
    back = files.read(spark, str(tmp_path / fmt), "jsonl" if fmt == "json" else fmt, "k string, n long, x double")
    assert sorted(map(tuple, back.collect())) == [("a", 1, 2.5), ("b", None, None)]


def test_json_array(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"entity_key": "u1", "click": 10}, {"entity_key": "u2", "click": 25}]))
    assert files.read(spark, str(tmp_path / "b.json"), "json").count() == 2


def test_partitioned_export_and_merge(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "f", 1.0, datetime(2024, 1, 1, 5), 1), ("u2", "f", 2.0, datetime(2024, 1, 2, 5), 2)], "entity string, feature string, value double, ts timestamp, version long")
    files.export_partitioned(rows, str(tmp_path / "o"), "user")
    read = spark.read.parquet(str(tmp_path / "o")).filter("date = '2024-01-02'")
    assert read.count() == 1 and "PartitionFilters: [isnotnull(date" in read._jdf.queryExecution().executedPlan().toString()
    newer = rows.withColumn("value", F.col("value") + 1).withColumn("ts", F.col("ts") + F.expr("interval 1 day")).limit(1)
    assert sorted(r.value for r in files.merge(rows, newer).collect()) in ([2.0, 2.0], [1.0, 3.0])


def test_keys_and_blobs(spark, tmp_path):
    keys = spark.createDataFrame([("user:1",), ("",), ("a/../b",), ("x" * 600,), ("a\x01",), (None,)], "k string")
    assert files.rejected(keys, "k").count() == 5
    (tmp_path / "x.bin").write_bytes(b"hello world")
    assert bytes(files.blobs(spark, str(tmp_path / "x.bin"), 6, 5).first().content) == b"world"
    assert files.warehouse_query('s.t"x', "e", "ts", ["a"], 5) == 'SELECT "e", "ts", "a" FROM "s"."t""x" LIMIT 5'


def test_groups(spark):
    g = schemas.Group("g", "user", {"click_count": "INT64", "score": "float64", "gone": "string"}, rules={"score": {"max": 1}})
    df = spark.createDataFrame([("u", datetime(2024, 1, 1), "7", 0.5), ("v", datetime(2024, 1, 1), "x", 2.0)], "entity string, ts timestamp, click_count string, score double")
    out = g.conformed(df).withColumn("why", g.reasons()).collect()
    assert [(r.click_count, r.gone, r.why) for r in out] == [(7, None, []), (None, None, ["score:max"])]
    new = schemas.Group("g", "user", {"click_count": "float64", "score": "int64"})
    assert schemas.incompatible(g, new, "none") == [] and len(schemas.incompatible(g, new, "backward")) == 1 and len(schemas.incompatible(g, new, "full")) == 3
    assert schemas.inferred(df, "n", "user").features == {"click_count": "string", "score": "float64"}


def test_registry(spark):
    r = Registry()

    @r.on_demand("x")
    def doubled(x):
        return x * 2

    import pandas as pd

    @r.transform("double", "x")
    def plus(x: pd.Series) -> pd.Series:
        return x + 1

    @r.aggregate("double", "x")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    df = spark.createDataFrame([("a", 1.0), ("a", 4.0)], "k string, x double")
    assert [(o.doubled, o.plus) for o in r.applied(df, "doubled", "plus").collect()] == [(2.0, 2.0), (8.0, 5.0)]
    assert r.aggregated(df, ["k"], "spread").first().spread == 3.0


def test_privacy(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"))
    noisy = [statistics.private_count(df, 1.0, s).first().n for s in range(12)]
    assert 985 < sum(noisy) / 12 < 1015 and len(set(noisy)) == 12
    share = df.select(statistics.randomized_response(F.col("x") < 5, 2.0, 3).cast("double").alias("a")).agg(F.avg("a")).first()[0]
    assert 0.4 < share < 0.6


def events_stream(spark, tmp_path, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "entity string, feature string, value double, ts timestamp, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    return spark.readStream.schema("entity string, feature string, value double, ts timestamp, version long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))


def test_stream_sequences(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = [[("u", "login", 1.0, t(0), 1), ("u", "view", 1.0, t(1), 2), ("u", "purchase", 1.0, t(3), 3), ("v", "login", 1.0, t(0), 4), ("v", "purchase", 1.0, t(50), 5)]]
    stream = events_stream(spark, tmp_path, rows).withWatermark("ts", "1 minute")
    out = pipelines.run_to_end(spark, patterns.match_sequences(stream, ["login", "purchase"], 10))
    assert [(r.entity, (r.last_ts - r.first_ts).seconds) for r in out.collect()] == [("u", 3)]


def test_stream_equals_batch_and_routes(spark, tmp_path):
    rows = [[("u", "a", float(i), datetime(2024, 1, 1, i), i) for i in range(5)], [("v", "b", float(i), datetime(2024, 1, 1, i), i) for i in range(5)]]
    stream = events_stream(spark, tmp_path, rows)
    got = pipelines.run_to_end(spark, pipelines.windowed(stream, "2 hours", ["entity"], "1 day"), "complete")
    assert sorted((r.entity, r.n) for r in got.collect()) == [(k, n) for k in "uv" for n in (1, 2, 2)]
    seen = {"x": 0, "rest": 0}
    sinks = {n: (lambda b, i, n=n: seen.__setitem__(n, seen[n] + b.count())) for n in seen}
    pipelines.routed(stream, {"x": "entity = 'u'", "rest": "entity <> 'u'"}, sinks, spark).awaitTermination()
    assert seen == {"x": 5, "rest": 5}


def test_changes(spark):
    msgs = spark.createDataFrame([('{"op":"c","lsn":1,"after":{"id":1,"v":2.0}}',), ('{"op":"d","lsn":3,"before":{"id":1,"v":2.0}}',), ('{"op":"c","lsn":2,"after":{"id":2,"v":5.0}}',)], "json string")
    rows = pipelines.envelope(msgs, "id long, v double").select("op", "lsn", "row.id", "row.v")
    assert [(r.id, r.v) for r in pipelines.applied(rows, ["id"]).collect()] == [(2, 5.0)]
