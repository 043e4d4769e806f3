"""Queries J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, lookups
from ..registry import query
from ..tables import features, load, micros

E = "(SELECT user_id, event_type, value, ts, event_id FROM events)"


@query("op_J01_equi_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def equi_join(spark, sf):
    o, c, n = (load(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("op_J02_cross_join", "SELECT r_name, n_name FROM region, nation")
def cross_join(spark, sf):
    """Both tables have a fixed size."""
    return load(spark, sf, "region").select("r_name").crossJoin(load(spark, sf, "nation").select("n_name"))


NEAR = """SELECT a.event_id AS left_event, b.event_id AS right_event FROM (SELECT * FROM events WHERE event_type = 'click') a {} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {} * 1000000::BIGINT"""


def _near(spark, sf, seconds, how):
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    out = joins.within(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", seconds, how)
    return out.select(F.col("left_event_id").alias("left_event"), F.col("right_event_id").alias("right_event"))


@query("op_J03_temporal_join", """WITH a AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT * FROM events WHERE event_type = 'error'),
l AS (SELECT user_id, count(*) AS n_left FROM a GROUP BY 1), r AS (SELECT user_id, count(*) AS n_right FROM b GROUP BY 1),
h AS (SELECT DISTINCT a.user_id FROM a JOIN b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000)
SELECT coalesce(l.user_id, r.user_id) AS user_id, n_left, n_right, h.user_id IS NOT NULL AS matched FROM l FULL JOIN r ON l.user_id = r.user_id LEFT JOIN h ON h.user_id = coalesce(l.user_id, r.user_id)""")
def temporal_join(spark, sf):
    e = load(spark, sf, "events").select("user_id", "ts", "event_type")
    return joins.any_within(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), "user_id", 600, "full")


@query("op_J04_interval_join", NEAR.format("", 3600))
def interval_join(spark, sf):
    return _near(spark, sf, 3600, "inner")


@query("op_J04_interval_join_left", NEAR.format("LEFT", 1800))
def interval_join_left(spark, sf):
    return _near(spark, sf, 1800, "left")


@query("op_J04_interval_join_full", NEAR.format("FULL", 900))
def interval_join_full(spark, sf):
    return _near(spark, sf, 900, "full")


@query("op_J08_tolerance_join_right", NEAR.format("RIGHT", 5))
def tolerance_join(spark, sf):
    return _near(spark, sf, 5, "right")


PIT = """SELECT q.user_id, epoch_us(q.ts) AS ts, epoch_us(v.ts) AS feature_ts, v.value FROM (SELECT user_id, ts FROM events WHERE event_type = 'purchase') q
ASOF JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) v ON q.user_id = v.user_id AND q.ts >= v.ts WHERE v.ts >= q.ts - INTERVAL 1 DAY"""


def point_in_time_rows(spark, sf, how="inner", seconds=86400):
    h = features(spark, sf)
    spine = h.filter("feature = 'purchase'").select("entity", "ts")
    return joins.point_in_time(spine, h.filter("feature = 'click'"), ["entity"], ["value"], seconds, how, tie=["version"], band_seconds=7 * 86400)


@query("op_J05_point_in_time", PIT)
def point_in_time(spark, sf):
    return point_in_time_rows(spark, sf).select(F.col("entity").alias("user_id"), micros("ts").alias("ts"), micros("feature_ts").alias("feature_ts"), "value")


@query("op_J05_point_in_time_left", "SELECT q.user_id, epoch_us(q.ts) AS ts, v.value FROM (SELECT user_id, ts FROM events WHERE event_type = 'purchase') q ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) v ON q.user_id = v.user_id AND q.ts >= v.ts")
def point_in_time_left(spark, sf):
    return point_in_time_rows(spark, sf, "left", None).select(F.col("entity").alias("user_id"), micros("ts").alias("ts"), "value")


@query("op_J06_training_set", """SELECT q.user_id AS entity, epoch_us(q.ts) AS ts, v.value FROM (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1) q
ASOF JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON q.user_id = v.user_id AND q.ts >= v.ts WHERE v.ts >= q.ts - INTERVAL 30 DAY""")
def training_set(spark, sf):
    h = features(spark, sf)
    return joins.training_set(h.filter("feature = 'view'").drop("feature"), h.filter("feature = 'purchase'"), ["entity"], ["value"], 30 * 86400).select("entity", micros("ts").alias("ts"), "value")


@query("op_J07_latest_rows", "SELECT user_id AS entity, arg_max(event_type, (ts, event_id)) AS feature, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_rows(spark, sf):
    newest = F.max(F.struct("ts", "version", "feature", "value")).alias("r")
    return features(spark, sf).groupBy("entity").agg(newest).select("entity", "r.feature", "r.value")


@query("op_J09_map_merge", "SELECT c_custkey, coalesce(n_name, 'none') AS name, [c_acctbal, n_nationkey::DOUBLE] AS parts FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def map_merge(spark, sf):
    """Maps of both sides merged, the last wins; values concatenated in declared order."""
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    left = F.create_map(F.lit("name"), F.lit("none"))
    right = F.when(F.col("n_name").isNotNull(), F.create_map(F.lit("name"), F.col("n_name"))).otherwise(F.map_filter(left, lambda k, v: F.lit(False)))
    merged = F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", merged["name"].alias("name"), F.array("c_acctbal", F.col("n_nationkey").cast("double")).alias("parts"))


@query("op_J10_lookup_default", "SELECT l_orderkey, l_linenumber, coalesce(p_retailprice, -1.0) AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey")
def lookup_default(spark, sf):
    prices = load(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return load(spark, sf, "lineitem").join(prices, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_retailprice", F.lit(-1.0)).alias("price"))


@query("op_J11_multi_join", """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def multi_join(spark, sf):
    l, o, c, n, r = (load(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("op_J13_reconciliation", """WITH a AS (SELECT user_id AS entity, event_type AS feature, arg_max(value, (ts, event_id)) AS online FROM events WHERE event_id % 10 <> 3 GROUP BY 1, 2),
b AS (SELECT user_id AS entity, event_type AS feature, arg_max(value, (ts, event_id)) AS offline FROM events WHERE event_id % 7 <> 2 GROUP BY 1, 2)
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.feature, b.feature) AS feature, CASE WHEN offline IS NULL THEN 'online_only' WHEN online IS NULL THEN 'offline_only' WHEN abs(online - offline) <= 0.5 THEN 'match' ELSE 'mismatch' END AS status FROM a FULL JOIN b ON a.entity = b.entity AND a.feature = b.feature""")
def reconciliation(spark, sf):
    h = features(spark, sf)
    a, b = (lookups.latest(h.filter(f)).select("entity", "feature", "value") for f in ("version % 10 <> 3", "version % 7 <> 2"))
    return joins.reconciled(a, b, ["entity", "feature"], 0.5).select("entity", "feature", "status")
