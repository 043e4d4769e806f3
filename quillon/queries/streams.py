"""Queries T and L: windows, late data, sequences, change streams and front ends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from ..plans import pipelines, streamsql
from ..registry import query
from ..streaming import patterns, pipelines as streams
from ..tables import features, load, micros

R = F.round


def _sums():
    return {"n": F.count("*"), "s": R(F.sum("value"), 6)}


def _flat(df):
    return df.withColumn("window_start", micros("window_start")).withColumn("window_end", micros("window_end"))


@query("op_T01_tumbling", "SELECT user_id AS entity, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 AS window_end, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1, 2, 3")
def tumbling(spark, sf):
    return _flat(windows.tumbling(features(spark, sf), "1 hour", ["entity"], _sums()))


@query("op_T01_weekly", "SELECT event_type AS feature, epoch_us(date_trunc('week', ts)::TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def weekly(spark, sf):
    out = windows.tumbling(features(spark, sf), "7 days", ["feature"], {"n": F.count("*")}, start=windows.MONDAY)
    return out.select("feature", micros("window_start").alias("window_start"), "n")


@query("op_T02_sliding", "SELECT user_id AS entity, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - k * 3600000000 AS window_start, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - k * 3600000000 + 7200000000 AS window_end, count(*) AS n, round(sum(value), 6) AS s FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2, 3")
def sliding(spark, sf):
    return _flat(windows.sliding(features(spark, sf), "2 hours", "1 hour", ["entity"], _sums()))


SESSION = """SELECT {0} AS {1}, epoch_us(min(ts)) AS window_start, epoch_us(max(ts)) + 1800000000 AS window_end, count(*) AS n, round(sum(value), 6) AS s FROM (SELECT *, sum(fresh) OVER (PARTITION BY {0} ORDER BY ts, event_id) AS g
FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {0} ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY {0}, g"""


@query("op_T03_session", SESSION.format("user_id", "entity"))
def session(spark, sf):
    return _flat(windows.session(features(spark, sf), "30 minutes", ["entity"], _sums()))


@query("op_T04_session_by_type", SESSION.format("event_type", "feature"))
def session_by_type(spark, sf):
    return _flat(windows.session(features(spark, sf), "30 minutes", ["feature"], _sums()))


@query("op_T05_global_window", "SELECT event_type AS feature, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1")
def global_window(spark, sf):
    return features(spark, sf).groupBy("feature").agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("s"))


@query("op_T06_first_event_windows", """WITH RECURSIVE e AS (SELECT user_id AS entity, epoch_us(ts) AS t, value FROM events),
w(entity, a) AS (SELECT entity, min(t) FROM e GROUP BY 1 UNION ALL SELECT w.entity, min(e.t) FROM w JOIN e ON e.entity = w.entity AND e.t >= w.a + 3600000000 GROUP BY w.entity, w.a)
SELECT w.entity, a AS window_start, count(*) AS n, round(sum(value), 6) AS s FROM w JOIN e ON e.entity = w.entity AND e.t >= a AND e.t < a + 3600000000 GROUP BY 1, 2""")
def first_event_windows(spark, sf):
    """Windows that start at a key's first event after the last one ended."""
    return patterns.first_event_windows(features(spark, sf), "entity", 3600).select("entity", micros("window_start").alias("window_start"), "n", R("s", 6).alias("s"))


@query("op_T07_last_window", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def last_window(spark, sf):
    e = load(spark, sf, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("_last")))  # one row
    return e.crossJoin(last).filter(F.col("ts") >= F.col("_last") - F.expr("interval 2 hours")).select("event_id")


@query("op_T10_late_policy", "SELECT event_id, coalesce(epoch_us(ts) < max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000, false) AS late FROM events")
def late_policy(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", windows.late(e, ["user_id"], 3600, ["event_id"]).alias("late"))


@query("op_T11_wall_clock_late", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 MINUTE")
def wall_clock_late(spark, sf):
    return load(spark, sf, "events").filter("ts >= timestamp'2024-01-19 23:55:00'").select("event_id")


NEXT = "SELECT a.user_id AS entity, epoch_us(a.ts) AS first_ts, epoch_us(min(b.ts)) AS second_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= {0} AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY a.event_id, 1, 2"


@query("op_T14_sequence_timeout", NEXT.format(86400 * 10**6))
def sequence_timeout(spark, sf):
    out = patterns.followed_by(features(spark, sf), "entity", "click", "purchase", 86400)
    return out.select("entity", micros("first_ts").alias("first_ts"), micros("second_ts").alias("second_ts"))


@query("op_T15_sequence_expiry", NEXT.format(3600 * 10**6))
def sequence_expiry(spark, sf):
    out = patterns.followed_by(features(spark, sf), "entity", "click", "purchase", 3600)
    return out.select("entity", micros("first_ts").alias("first_ts"), micros("second_ts").alias("second_ts"))


@query("op_T13_contiguous_sequence", "SELECT user_id AS entity, count(*) AS n FROM (SELECT user_id, event_type, lead(event_type) OVER w AS nx, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND nx = 'purchase' AND d <= 86400000000 GROUP BY 1")
def contiguous(spark, sf):
    w = Window.partitionBy("entity").orderBy("ts", "version")
    h = features(spark, sf).withColumn("nx", F.lead("feature").over(w)).withColumn("d", F.lead(F.unix_micros("ts")).over(w) - F.unix_micros("ts"))
    return h.filter("feature = 'click' and nx = 'purchase' and d <= 86400000000").groupBy("entity").agg(F.count("*").alias("n"))


@query("op_T17_transaction_dedup", "SELECT DISTINCT user_id, epoch_us(ts) AS ts, trunc(value * 1000)::BIGINT AS v FROM events")
def transaction_dedup(spark, sf):
    return load(spark, sf, "events").select("user_id", micros("ts").alias("ts"), F.when(F.col("value") < 0, F.ceil(F.col("value") * 1000)).otherwise(F.floor(F.col("value") * 1000)).alias("v")).distinct()


@query("op_T19_pipeline_spec", "SELECT user_id, count(doubled) AS n, round(sum(doubled), 6) AS total FROM (SELECT user_id, value * 2 AS doubled FROM events WHERE event_type = 'click') WHERE doubled > 20 GROUP BY 1")
def pipeline_spec(spark, sf):
    S = pipelines.Step
    steps = [S("out", "sink", ["agg"], {"columns": ["user_id", "n", "total"]}), S("agg", "aggregate", ["big"], {"keys": ["user_id"], "aggregates": {"n": ("count", "doubled"), "total": ("sum", "doubled")}}), S("big", "filter", ["double"], {"where": "doubled > 20"}), S("double", "transform", ["clicks"], {"columns": {"doubled": "value * 2"}}), S("clicks", "filter", ["events"], {"where": "event_type == 'click'"}), S("events", "source", [], {"table": "events"})]
    out = pipelines.built(steps, {"events": load(spark, sf, "events")})["out"]
    return out.select("user_id", "n", R("total", 6).alias("total"))


@query("op_T01_stream_tumbling", "SELECT event_type AS feature, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    """The same windows on a stream, run to the end of its input; all late data is let in."""
    out = streams.run_to_end(spark, streams.windowed(streams.events(spark, sf), "1 day", ["feature"], "60 days"), "complete")
    return out.select("feature", micros("window_start").alias("window_start"), "n", R("s", 6).alias("s"))


@query("op_U01_stream_deduplicate", "SELECT DISTINCT user_id AS entity, event_type AS feature FROM events")
def stream_deduplicate(spark, sf):
    return streams.run_to_end(spark, streams.events(spark, sf).select("entity", "feature").dropDuplicates(["entity", "feature"]), "append")


@query("op_T22_materialized_view", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def materialized_view(spark, sf):
    view = streams.MaterializedView(spark, "by_type", lambda: load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")))
    view.refresh()
    return view.read()


@query("op_T24_change_apply", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def change_apply(spark, sf):
    changes = load(spark, sf, "events").select("user_id", "value", F.col("event_id").alias("lsn"), F.when(F.col("event_type") == "error", "d").otherwise("u").alias("op"))
    return streams.applied(changes, ["user_id"]).select("user_id", "value")


@query("op_S21_change_envelope", "SELECT event_id AS lsn, user_id, value FROM events WHERE event_type <> 'error'")
def change_envelope(spark, sf):
    e = load(spark, sf, "events")
    body = F.to_json(F.struct(F.when(F.col("event_type") == "error", "d").otherwise("u").alias("op"), F.struct("user_id", "value").alias("after"), F.col("event_id").alias("lsn")))
    return streams.envelope(e.select(body.alias("json")), "user_id long, value double").filter("op <> 'd'").select("lsn", "row.user_id", "row.value")


L01 = "SELECT event_type, count(*) AS n, sum(value) AS s, stddev_pop(value) AS sd FROM events WHERE value > 10 AND event_type <> 'error' OR value > 90 GROUP BY event_type HAVING n > 5 ORDER BY n DESC LIMIT 4"


@query("op_L01_stream_sql", "SELECT event_type, n, round(s, 4) AS s, round(sd, 6) AS sd FROM (SELECT event_type, count(*) AS n, sum(value) AS s, stddev_pop(value) AS sd FROM events WHERE value > 10 AND event_type <> 'error' OR value > 90 GROUP BY event_type HAVING count(*) > 5 ORDER BY n DESC LIMIT 4)")
def stream_sql(spark, sf):
    out = streamsql.execute(L01, {"events": load(spark, sf, "events")})
    return out.select("event_type", "n", R("s", 4).alias("s"), R("sd", 6).alias("sd"))


@query("op_L01_window_clause", "SELECT user_id, count(*) AS n, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start FROM events GROUP BY 1, 3")
def window_clause(spark, sf):
    out = streamsql.execute("SELECT user_id, count(*) AS n FROM events GROUP BY user_id WINDOW TUMBLE(ts, '24h')", {"events": load(spark, sf, "events")})
    return out.select("user_id", "n", micros("window_start").alias("window_start"))


@query("op_L01_join", "SELECT c.c_name AS name, o.o_totalprice AS price FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 150000")
def stream_join(spark, sf):
    return streamsql.execute("SELECT c.c_name AS name, o.o_totalprice AS price FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 150000", {"orders": load(spark, sf, "orders"), "customer": load(spark, sf, "customer")})


@query("op_L02_create_feature", "SELECT user_id, round(sum(value), 6) AS spend FROM events WHERE event_type = 'purchase' GROUP BY 1")
def create_feature(spark, sf):
    _, df = streamsql.create_feature("CREATE FEATURE spend AS SELECT user_id, sum(value) AS spend FROM events WHERE event_type = 'purchase' GROUP BY user_id", {"events": load(spark, sf, "events")})
    return df.withColumn("spend", R("spend", 6))


@query("op_L03_over_window", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), 6) AS s FROM events")
def over_window(spark, sf):
    load(spark, sf, "events").createOrReplaceTempView("quillon_events")
    return spark.sql(streamsql.rewritten("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id WINDOW '6h'), 6) AS s FROM quillon_events"))


@query("op_L04_transform_language", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS d FROM lineitem WHERE l_quantity > 10 AND (l_tax < 0.03 OR l_linenumber = 1) GROUP BY 1 ORDER BY 1 LIMIT 3")
def transform_language(spark, sf):
    out = streamsql.execute("SELECT l_returnflag, count(*) AS n, sum(l_extendedprice * l_discount) AS d FROM lineitem WHERE l_quantity > 10 AND (l_tax < 0.03 OR l_linenumber = 1) GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 3", {"lineitem": load(spark, sf, "lineitem")})
    return out.select("l_returnflag", "n", R("d", 2).alias("d"))
