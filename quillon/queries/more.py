"""Queries of streams run to the end of their input, declared streams, and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.expressions import compiled, register
from ..functions.registry import Registry
from ..operators import lookups
from ..plans import catalog, composition, questions
from ..registry import query
from ..sources import files
from ..streaming import pipelines as streams
from ..tables import features, load, micros
from .storage import scratch, through

R = F.round


@query("op_T02_stream_sliding", "SELECT event_type AS feature, epoch_us(time_bucket(INTERVAL 12 HOUR, ts)) - k * 43200000000 AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    out = streams.run_to_end(spark, streams.windowed(streams.events(spark, sf), "24 hours", ["feature"], "60 days", "12 hours"), "complete")
    return out.select("feature", micros("window_start").alias("window_start"), "n")


@query("op_T03_stream_session", """SELECT entity, count(*) AS sessions, sum(n)::BIGINT AS n FROM (SELECT user_id AS entity, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g) GROUP BY 1""")
def stream_session(spark, sf):
    out = streams.run_to_end(spark, streams.sessions(streams.events(spark, sf), "2 hours", ["entity"], "60 days"), "complete")
    return out.groupBy("entity").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("op_J04_stream_join", "SELECT a.event_id AS left_event, b.event_id AS right_event FROM (SELECT * FROM events WHERE event_type = 'click') a JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000")
def stream_join(spark, sf):
    e = streams.events(spark, sf)
    out = streams.joined(e.filter("feature = 'click'"), e.filter("feature = 'purchase'"), "entity", 3600, lateness="60 days")
    return streams.run_to_end(spark, out.select(F.col("left_version").alias("left_event"), F.col("right_version").alias("right_event")))


@query("op_T09_watermark_append", "SELECT event_type AS feature, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL 1 DAY, ts)) + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000")
def watermark_append(spark, sf):
    """Windows that the watermark has closed at the end of the input."""
    out = streams.run_to_end(spark, streams.windowed(streams.events(spark, sf), "1 day", ["feature"], "1 day"))
    return out.select("feature", micros("window_start").alias("window_start"), "n")


@query("op_T20_declared_stream", "SELECT user_id, count(*) AS n, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start FROM events GROUP BY 1, 3")
def declared_stream(spark, sf):
    c = catalog.Streams({"clicks": load(spark, sf, "events")})
    c.run("CREATE STREAM clicks (user_id long, value double, ts timestamp, WATERMARK FOR ts AS '10m')")
    _, df = c.run("SELECT user_id, count(*) AS n FROM clicks GROUP BY user_id WINDOW TUMBLING(ts, '1d') EMIT CHANGES")
    return df.select("user_id", "n", micros("window_start").alias("window_start"))


@query("op_X02_user_functions", "SELECT event_id, round(value * 2, 6) AS doubled, round(value + 1, 6) AS plus FROM events")
def user_functions(spark, sf):
    r = Registry()
    r.add("doubled", "column", lambda v: F.round(v * 2, 6), ["value"])
    r.add("plus", "transform", F.udf(lambda v: round(v + 1, 6), "double", useArrow=True), ["value"])
    return r.applied(load(spark, sf, "events"), "doubled", "plus").select("event_id", "doubled", "plus")


@query("op_X04_user_aggregate", "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def user_aggregate(spark, sf):
    r = Registry()
    r.add("spread", "column", lambda v: F.round(F.max(v) - F.min(v), 6), ["value"])
    return r.aggregated(load(spark, sf, "events"), ["event_type"], "spread")


@query("op_X07_chunk_table", "SELECT item_id, count(*) AS chunks FROM (SELECT item_id, unnest(range(0, greatest(ceil((length(text) - 20) / 80.0)::BIGINT, 1))) FROM benchmark WHERE length(text) > 0) GROUP BY 1")
def chunk_table(spark, sf):
    return V.chunks(load(spark, sf, "benchmark"), 100, 20, "item_id").groupBy("item_id").agg(F.count("*").alias("chunks"))


@query("op_X17_question", "SELECT user_id, round(sum(value), 6) AS answer FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 5")
def question(spark, sf):
    return questions.answered("top 5 user_id by total value where event_type = 'purchase'", "events", load(spark, sf, "events")).withColumn("answer", R("answer", 6))


@query("op_M02_ks_with_ties", "SELECT round(max(abs(ca / na - cb / nb)), 6) AS ks FROM (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY v))")
def ks_with_ties(spark, sf):
    from ..functions import statistics as S

    li = load(spark, sf, "lineitem")
    return S.ks(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), "l_quantity").select(R("ks", 6).alias("ks"))


@query("op_S01_missing_features", "SELECT e.entity, count(l.feature) AS n FROM (SELECT unnest([1, 2, 100000]) AS entity) e LEFT JOIN (SELECT DISTINCT user_id, event_type AS feature FROM events) l ON l.user_id = e.entity GROUP BY 1")
def missing_features(spark, sf):
    asked = spark.createDataFrame([(1,), (2,), (100000,)], "entity int")
    return asked.join(features(spark, sf).select("entity", "feature").distinct(), "entity", "left").groupBy("entity").agg(F.count("feature").alias("n"))


@query("op_S13_offline_sync", "SELECT user_id AS entity, event_type AS feature, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def offline_sync(spark, sf):
    """Current values after a sync from JSON lines and Parquet."""
    h = features(spark, sf).select("entity", "feature", "value", "ts", "version")
    parts = [through(h.filter(F.col("version") % 2 == k), fmt, "entity long, feature string, value double, ts timestamp, version long") for k, fmt in ((0, "jsonl"), (1, "parquet"))]
    return lookups.latest(parts[0].unionByName(parts[1])).select("entity", "feature", "value")


@query("op_S15_query_passthrough", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def query_passthrough(spark, sf):
    load(spark, sf, "customer").createOrReplaceTempView("quillon_customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM quillon_customer GROUP BY 1")


@query("op_K02_history_append", "SELECT user_id AS entity, event_type AS feature, event_id AS version FROM events")
def history_append(spark, sf):
    path, h = scratch(spark), features(spark, sf)
    for k in (0, 1):
        files.write(h.filter(F.col("version") % 2 == k), path, "parquet", "append")
    return files.read(spark, path, "parquet").select("entity", "feature", "version")


@query("op_K10_connector_export", "SELECT s_suppkey, s_name FROM supplier")
def connector_export(spark, sf):
    return through(load(spark, sf, "supplier").select("s_suppkey", "s_name"), "csv", "s_suppkey long, s_name string")


@query("op_K13_batch_sink", "SELECT user_id AS entity, event_id AS version FROM events WHERE event_type = 'click'")
def batch_sink(spark, sf):
    """Micro-batches written to a folder named by their number: a repeated batch replaces itself."""
    path = scratch(spark)
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    streams.routed(streams.events(spark, sf), {"out": "feature = 'click'"}, {"out": sink}, spark).awaitTermination()
    return spark.read.parquet(path).select("entity", "version")


@query("op_K14_exchange_count", "SELECT count(*) AS n FROM events")
def exchange_count_all(spark, sf):
    return load(spark, sf, "events").agg(F.count("*").alias("n"))


@query("op_T16_checkpoint_restore", "SELECT DISTINCT user_id AS entity, event_type AS feature FROM events")
def checkpoint_restore(spark, sf):
    """A stream stopped after half its input and started again from its state yields nothing twice."""
    source, sink, state = scratch(spark), scratch(spark), streams.checkpoint_path(spark)
    h = features(spark, sf).select("entity", "feature", "version")
    for k in (0, 1):
        h.filter(F.col("version") % 2 == k).write.mode("append").parquet(source)
        s = spark.readStream.schema(h.schema).parquet(source).dropDuplicates(["entity", "feature"]).select("entity", "feature")
        s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


@query("op_T23_change_pipeline", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def change_pipeline(spark, sf):
    """Change messages as a stream, applied after its end by their log positions."""
    msg = F.to_json(F.struct(F.when(F.col("feature") == "error", "d").otherwise("u").alias("op"), F.struct(F.col("entity").alias("user_id"), "value").alias("after"), F.col("version").alias("lsn")))
    rows = streams.envelope(streams.events(spark, sf).select(msg.alias("json")), "user_id long, value double").select("op", "lsn", "row.user_id", "row.value")
    return streams.applied(streams.run_to_end(spark, rows), ["user_id"]).select("user_id", "value")


@query("op_X03_script_registry", "SELECT event_id, round(sqrt(abs(value)) + 1, 6) AS v FROM events")
def script_registry(spark, sf):
    return load(spark, sf, "events").select("event_id", R(compiled("sqrt(abs(value)) + 1", "script"), 6).alias("v"))


@query("op_X06_custom_function", "SELECT event_id, round(value * value + 1, 6) AS v FROM events")
def custom_function(spark, sf):
    register("square", lambda x: x * x)
    return load(spark, sf, "events").select("event_id", R(compiled("square(value) + 1"), 6).alias("v"))


@query("op_V06_collection_search", "SELECT vec_id, distance FROM (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE label = 3) ORDER BY distance, vec_id LIMIT 5")
def collection_search(spark, sf):
    e = load(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return V.nearest(e.filter("label = 3"), q, 5)


@query("op_L05_derive_language", "SELECT event_id, round((value + 1) / 2, 6) AS half FROM events")
def derive_language(spark, sf):
    out = composition.derived(load(spark, sf, "events"), "SOURCE value\nDERIVE more AS value + 1 FROM value\nDERIVE half AS more / 2 FROM more")
    return out.select("event_id", R("half", 6).alias("half"))
