"""Queries of ingestion, keyed stores, schedules, sharding, query languages and running pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cron, scalars
from ..functions.registry import Registry
from ..operators import graphs, lookups, sharding, windows
from ..plans import graphql, pipelines
from ..registry import query
from ..shared import new_path
from ..sources import files, kv, push
from ..streaming import patterns
from ..streaming import pipelines as streams
from ..tables import as_of, features, load, micros

KINDS = "SELECT user_id AS entity, event_type AS feature, arg_max(value, (ts, event_id)) AS value FROM events {0} GROUP BY 1, 2"

PUSHED = """CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '../' || user_id WHEN event_id % 17 = 0 THEN 'a' || chr(7) ELSE 'u' || user_id END AS entity, event_id % 19 = 0 AS bare"""


@query("op_S10_push_checked", f"SELECT event_id, CASE WHEN entity = '' THEN 'empty key' WHEN contains(entity, chr(7)) THEN 'control character in key' WHEN contains(entity, '../') THEN 'path in key' WHEN bare THEN 'no features' END AS error FROM (SELECT event_id, {PUSHED} FROM events)")
def push_checked(spark, sf):
    """A bulk push: each update with the reason it is refused for, or null."""
    e = load(spark, sf, "events")
    n = F.col("event_id")
    entity = F.when(n % 11 == 0, "").when(n % 13 == 0, F.concat(F.lit("../"), "user_id")).when(n % 17 == 0, "a\x07").otherwise(F.concat(F.lit("u"), "user_id"))
    maps = F.when(n % 19 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map("event_type", "value"))
    return push.checked(e.select("event_id", entity.alias("entity"), maps.alias("features"))).select("event_id", "error")


@query("op_S10_push_rate", "SELECT event_id, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 1000000 ORDER BY ts, event_id) <= 1 AS admitted FROM events")
def push_rate(spark, sf):
    """Requests that a limit for each client and second admits."""
    return push.admitted(load(spark, sf, "events"), "event_type", "ts", 1, "event_id").select("event_id", "admitted")


@query("op_S11_message_decode", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not JSON' WHEN event_id % 5 = 0 THEN 'empty key' END AS error, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def message_decode(spark, sf):
    """A topic's messages as the consumer gets them, run as a stream: updates, and dead letters with the reason."""
    rows = streams.events(spark, sf).withColumnRenamed("version", "event_id")
    good = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("entity").cast("string")).otherwise("").alias("entity"), F.create_map("feature", "value").alias("features")))
    messages = rows.select("event_id", F.col("feature").alias("key"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "feature")).otherwise(good).cast("binary").alias("value"))
    out = push.decoded(messages).select("event_id", "error", F.element_at(F.map_values("features"), 1).alias("value"))
    return streams.run_to_end(spark, out)


@query("op_S14_warehouse_import", "SELECT user_id, epoch_us(ts) AS ts, event_type, value FROM events")
def warehouse_import(spark, sf):
    """The import's SELECT, run by the warehouse that the session is itself."""
    load(spark, sf, "events").createOrReplaceTempView("quillon_events")
    sql = files.warehouse_query("quillon_events", "user_id", "ts", ["event_type", "value"], quote="`")
    return spark.sql(sql).withColumn("ts", micros("ts"))


@query("op_K11_warehouse_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def warehouse_upsert(spark, sf):
    """A table created by an export of two thirds, then batches that replace rows and add others."""
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_acctbal"))
    path = new_path(spark, "warehouse")
    c.filter("c_custkey % 3 < 2").write.parquet(f"{path}/version=0")
    for k, batch in enumerate((c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), c.filter("c_custkey % 3 = 2"))):
        push.upserted(spark.read.parquet(f"{path}/version={k}"), batch, ["c_custkey"]).write.parquet(f"{path}/version={k + 1}")
    return spark.read.parquet(f"{path}/version=2")


def _stored(spark, sf):
    path, h = new_path(spark, "kv"), features(spark, sf)
    for k in (0, 1):
        kv.put(h.filter(F.col("version") % 2 == k), path)
    return path


@query("op_K16_keyed_put", "SELECT user_id AS entity, event_type AS feature, event_id AS version FROM events")
def keyed_put(spark, sf):
    return spark.read.parquet(_stored(spark, sf)).select("entity", "feature", "version")


@query("op_S16_keyed_get", KINDS.format("WHERE user_id = 7") + " UNION ALL " + KINDS.format("WHERE user_id IN (1, 2, 3, 100000) AND event_type IN ('click', 'view')") + " UNION ALL " + KINDS.format("WHERE user_id = 5 AND ts <= TIMESTAMP '2024-01-10'"))
def keyed_get(spark, sf):
    """Get, batch get and get as of an instant, each of the asked keys' folders alone."""
    path = _stored(spark, sf)
    parts = kv.get(spark, path, 7), kv.batch_get(spark, path, [1, 2, 3, 100000], ["click", "view"]), kv.get(spark, path, 5, as_of=as_of("2024-01-10 00:00:00"))
    one, two, three = (p.select("entity", "feature", "value") for p in parts)
    return one.unionByName(two).unionByName(three)


@query("op_S24_source_poll", "SELECT user_id AS entity, event_id AS version FROM events")
def source_poll(spark, sf):
    """A folder polled twice while it grows: each poll takes what came since the one before."""
    source, sink, state = new_path(spark, "source"), new_path(spark, "sink"), streams.checkpoint_path(spark)
    h = features(spark, sf).select("entity", "version")
    for k in (0, 1):
        h.filter(F.col("version") % 2 == k).write.mode("append").parquet(source)
        poll = spark.readStream.schema(h.schema).parquet(source)
        poll.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(h.schema).parquet(sink)


@query("op_K03_bounded_queue", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def bounded_queue(spark, sf):
    """What a write queue of 5, emptied every hour, takes; the rest is dropped."""
    return push.queued(load(spark, sf, "events"), "ts", "event_id", 5, 3600).select("event_id")


RING = "(VALUES " + ", ".join(f"({p}, '{n}')" for p, n in sharding.ring(["a", "b", "c", "d", "e"], 4)) + ") r(p, node)"


@query("op_N09_shard_route", f"""SELECT c_custkey, list_transform(list_sort(list(s)), lambda x: x.node)[1:2] AS owners FROM (SELECT c_custkey, node, min({{'d': (p - h + 4503599627370496) % 4503599627370496, 'node': node}}) AS s
FROM (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 13))::BIGINT AS h FROM customer), {RING} GROUP BY 1, 2) GROUP BY 1""")
def shard_route(spark, sf):
    """The two owners of each key on a ring of five nodes."""
    return load(spark, sf, "customer").select("c_custkey", sharding.owners(F.col("c_custkey"), ["a", "b", "c", "d", "e"], 2, 4).alias("owners"))


@query("op_N09_quorum_read", "SELECT user_id AS entity, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 3) >= 2")
def quorum_read(spark, sf):
    r = features(spark, sf).select("entity", "value", "ts", "version", (F.col("version") % 3).alias("replica"))
    return sharding.quorum_read(r, ["entity"], 2).select("entity", "value")


@query("op_N09_counter_merge", "SELECT user_id, sum(up - down)::BIGINT AS value FROM (SELECT user_id, event_type, max(event_id) AS up, max(event_id % 10) AS down FROM events GROUP BY 1, 2) GROUP BY 1")
def counter_merge(spark, sf):
    c = load(spark, sf, "events").select("user_id", F.col("event_type").alias("replica"), F.col("event_id").alias("up"), (F.col("event_id") % 10).alias("down"))
    return sharding.counter(c, ["user_id"])


@query("op_L07_cron", """WITH m AS (SELECT t FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-12-31', INTERVAL 1 MINUTE) g(t) WHERE (minute(t) % 20 = 5) AND hour(t) BETWEEN 2 AND 4 AND dayofweek(t) IN (1, 3)),
e AS (SELECT event_id, ts, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS f FROM events)
SELECT event_id, epoch_us(m.t) AS next, (epoch_us(ts) // 5400000000 + 1) * 5400000000 AS every FROM e ASOF JOIN m ON m.t >= e.f""")
def cron_next(spark, sf):
    """Next runs of a schedule of five fields and of a fixed interval."""
    e = load(spark, sf, "events")
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    return e.select("event_id", at(cron.next_run(F.col("ts"), "5-59/20 2-4 * * 1,3")).alias("next"), at(cron.next_run(F.col("ts"), "@every 1h30m")).alias("every"))


@query("op_L06_aliases_and_variables", KINDS.format("WHERE event_type = 'click' AND user_id IN (1, 2, 3)").replace("entity", "who").replace("user_id AS who", "user_id AS who").replace("event_type AS feature, ", "event_type AS what, ").replace("AS value", "AS latest"))
def aliases_and_variables(spark, sf):
    text = 'query Q($n: String!, $who: [ID!] = [1, 2, 3]) { latest: feature(name: $n, entities: $who) { ...row } other: aggregation(name: "view", function: count) { entity value } } fragment row on Feature { who: entity what: feature latest: value }'
    return graphql.execute(features(spark, sf), text, {"n": "click"})["latest"]


@query("op_L06_nested_selection", "SELECT entity AS id, list(feature ORDER BY feature) AS names, list(value ORDER BY feature) AS amounts FROM (" + KINDS.format("WHERE event_type IN ('click', 'purchase')") + ") GROUP BY 1 UNION ALL SELECT DISTINCT user_id, []::VARCHAR[], []::DOUBLE[] FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type IN ('click', 'purchase'))")
def nested_selection(spark, sf):
    out = graphql.execute(features(spark, sf), '{ entities { id features(names: ["click", "purchase"]) { name: feature value } } }')["entities"]
    return out.select("id", F.col("features.name").alias("names"), F.col("features.value").alias("amounts"))


@query("op_T08_closed_windows", "SELECT event_type AS feature, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL 1 DAY, ts)) + 86400000000 + 300000000 < epoch_us(TIMESTAMP '2024-01-15')")
def closed_windows(spark, sf):
    """Windows that are closed at an instant: those whose end and lateness lie before it."""
    out = windows.tumbling(features(spark, sf), "1 day", ["feature"], {"n": F.count("*")})
    return windows.closed(out, "2024-01-15 00:00:00", 300).select("feature", micros("window_start").alias("window_start"), "n")


@query("op_T12_join_watermark", "SELECT user_id AS entity, min(epoch_us(ts)) - 5000000 AS watermark FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def join_watermark(spark, sf):
    """The watermark of each key's buffered sides: their least instant less the grace."""
    h = features(spark, sf)
    return windows.join_watermark(h.filter("feature = 'click'"), h.filter("feature = 'purchase'"), 5, ["entity"]).select("entity", micros("watermark").alias("watermark"))


@query("op_T18_declared_graph", "SELECT event_type AS kind, count(*) AS n, round(sum(value * 2), 4) AS total FROM events WHERE value > 10 GROUP BY 1")
def declared_graph(spark, sf):
    """A graph of source, filter, transform, aggregation and sink, declared out of order."""
    S = pipelines.Step
    steps = [
        S("out", "sink", ["sums"], {"rename": {"event_type": "kind", "n": "n", "total": "total"}}),
        S("sums", "aggregate", ["doubled"], {"keys": ["event_type"], "aggregates": {"n": ("count", "double"), "total": ("sum", "double")}}),
        S("doubled", "transform", ["some"], {"columns": {"double": "value * 2"}}),
        S("some", "filter", ["events"], {"where": "value > 10"}),
        S("events", "source", [], {"table": "events"}),
    ]
    return pipelines.built(steps, {"events": load(spark, sf, "events")})["out"].withColumn("total", F.round("total", 4))


@query("op_T13_sequence_stream", """SELECT a.user_id AS entity, epoch_us(a.ts) AS first_ts, epoch_us(min(b.ts)) AS last_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 7200000000
WHERE a.event_type = 'click' GROUP BY a.event_id, 1, 2""")
def sequence_stream(spark, sf):
    """A click and the next purchase of its key within two hours, matched by state on a stream."""
    found = patterns.match_sequences(streams.events(spark, sf).withWatermark("ts", "60 days"), ["click", "purchase"], 7200)
    return streams.run_to_end(spark, found).select("entity", micros("first_ts").alias("first_ts"), micros("last_ts").alias("last_ts"))


@query("op_T16_window_restore", "SELECT event_type AS feature, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def window_restore(spark, sf):
    """Windows over a stream that stopped half-way: the second run goes on with the counts that the first one's checkpoint holds."""
    source, state, sink = new_path(spark, "source"), streams.checkpoint_path(spark), new_path(spark, "result")
    h = features(spark, sf)
    last = []
    for k in (0, 1):
        h.filter(F.col("version") % 2 == k).write.mode("append").parquet(source)
        w = streams.windowed(spark.readStream.schema(h.schema).parquet(source), "1 day", ["feature"], "60 days")
        keep = lambda batch, number: (batch.write.mode("overwrite").parquet(f"{sink}/batch={number}"), last.append(number))
        w.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{sink}/batch={last[-1]}").select("feature", micros("window_start").alias("window_start"), "n")


@query("op_T21_paused_query", "SELECT user_id AS entity, event_id AS version, 'pending,paused,stopped,deleted' AS states FROM events")
def paused_query(spark, sf):
    """A query submitted, run, paused, gone on with after more input came, and deleted: all rows once, and its states."""
    source, state, sink = new_path(spark, "source"), streams.checkpoint_path(spark), new_path(spark, "sink")
    h = features(spark, sf).select("entity", "version")
    h.filter("version % 2 = 0").write.parquet(source)
    begin = lambda: spark.readStream.schema(h.schema).parquet(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q, states = streams.Queries(), []
    q.submit("copy", begin)
    states.append(q.status("copy"))
    q.run("copy").awaitTermination()
    q.pause("copy")
    states.append(q.status("copy"))
    h.filter("version % 2 = 1").write.mode("append").parquet(source)
    q.run("copy").awaitTermination()
    states.append(q.status("copy"))
    q.delete("copy")
    states.append(q.status("copy"))
    return spark.read.schema(h.schema).parquet(sink).withColumn("states", F.lit(",".join(states)))


@query("op_X01_reloaded_transform", "SELECT event_id, round(value * 3, 6) AS scaled FROM events")
def reloaded_transform(spark, sf):
    """A Python transform in Arrow batches; the version added last is the one that runs."""
    r = Registry()
    for factor in (2, 3):

        @r.transform("double", "value")
        def scaled(v, factor=factor):
            return (v * factor).round(6)

    return r.applied(load(spark, sf, "events"), "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("op_X05_version_routing", "SELECT event_id, CASE WHEN ('0x' || substr(sha256(user_id::VARCHAR || 'f'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE < 0.3 THEN round(value + 1, 6) ELSE round(value * 2, 6) END AS f FROM events")
def version_routing(spark, sf):
    """Two versions of a function, three tenths of the users on the first."""
    r = Registry()
    r.add("f", "column", lambda v: F.round(v + 1, 6), ["value"])
    r.add("f", "column", lambda v: F.round(v * 2, 6), ["value"])
    return load(spark, sf, "events").select("event_id", r.routed("f", F.col("user_id"), {1: 0.3, 2: 0.7}).alias("f"))


TREE = "(SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 's' || l_suppkey, 'o' || l_orderkey FROM lineitem)"


def _tree(spark, sf):
    edge = lambda t, a, x, b, y: load(spark, sf, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    parts = [edge("nation", "r", "n_regionkey", "n", "n_nationkey"), edge("customer", "n", "c_nationkey", "c", "c_custkey"), edge("supplier", "n", "s_nationkey", "s", "s_suppkey"), edge("orders", "c", "o_custkey", "o", "o_orderkey"), edge("lineitem", "s", "l_suppkey", "o", "l_orderkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query("op_G02_levels", f"WITH RECURSIVE e AS (SELECT * FROM {TREE}), t(node, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, t.level + 1 FROM t JOIN e ON e.src = t.node) SELECT node, max(level)::INT AS level FROM t GROUP BY 1")
def node_levels(spark, sf):
    """Levels of the graph of five tables: each node after all that lead to it."""
    return graphs.node_levels(_tree(spark, sf))


@query("op_G03_paths", f"WITH RECURSIVE e AS (SELECT * FROM {TREE}), t(s, p, node) AS (SELECT DISTINCT src, [src], src FROM e WHERE src LIKE 'r%' UNION ALL SELECT t.s, list_append(p, e.dst), e.dst FROM t JOIN e ON e.src = t.node WHERE len(p) <= 2) SELECT s AS start, node AS \"end\", p AS path FROM t WHERE node LIKE 's%' OR node LIKE 'c%'")
def paths(spark, sf):
    """All paths from regions to customers and suppliers."""
    e = _tree(spark, sf)
    node = lambda c, *kinds: e.select(F.col(c).alias("node")).filter(F.substring("node", 1, 1).isin(*kinds)).distinct()
    return graphs.simple_paths(e, node("src", "r"), node("dst", "c", "s"), 2)
