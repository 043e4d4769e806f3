"""Queries A, W, O, U: aggregation, window functions, order, top-k, set-like operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sets, windows
from ..registry import query
from ..tables import features, load, micros

R = lambda c, n=6: F.round(c, n)


@query("op_A01_sliding_preaggregate", """SELECT user_id AS entity, event_type AS feature, count(*) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, arg_max(value, (ts, event_id)) AS last
FROM events WHERE epoch(ts) >= 1705968000 AND floor(epoch(ts) / 86400) * 86400 >= floor(1706659200 / 86400) * 86400 - 7 * 86400 GROUP BY 1, 2""")
def sliding_preaggregate(spark, sf):
    width = windows.bucket_width(7 * 86400)
    out = windows.merged(windows.buckets(features(spark, sf), width), F.lit(1706659200), 7 * 86400, 86400)
    return out.withColumn("sum", R("sum")).withColumn("avg", R("avg"))


@query("op_A02_partial_merge", "SELECT user_id AS entity, event_type AS feature, count(*) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def partial_merge(spark, sf):
    """Hourly partials merged over all time equal one pass over the rows."""
    p = windows.buckets(features(spark, sf), 3600)
    return p.groupBy("entity", "feature").agg(F.sum("n").alias("count"), R(F.sum("s")).alias("sum"), F.min("lo").alias("min"), F.max("hi").alias("max"))


@query("op_A03_inactive_eviction", "SELECT user_id AS entity, event_type AS feature, count(*) AS n FROM events GROUP BY 1, 2 HAVING max(ts) >= TIMESTAMP '2024-01-28'")
def inactive_eviction(spark, sf):
    out = features(spark, sf).groupBy("entity", "feature").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    return out.filter("ts >= timestamp'2024-01-28 00:00:00'").drop("ts")


@query("op_A04_group_by", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, min(l_tax) AS min_tax, max(l_quantity) AS max_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def group_by(spark, sf):
    l = load(spark, sf, "lineitem").filter("l_shipdate <= timestamp'1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), R(F.sum("l_extendedprice"), 2).alias("sum_price"), R(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), R(F.avg("l_discount")).alias("avg_disc"), F.min("l_tax").alias("min_tax"), F.max("l_quantity").alias("max_qty"), F.count("*").alias("n"))


@query("op_A04_global_aggregate", "SELECT count(*) AS n, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'click'")
def global_aggregate(spark, sf):
    return load(spark, sf, "events").filter("event_type = 'click'").agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("op_A05_window_aggregates", """SELECT user_id AS entity, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, count(value) AS n, round(sum(value), 6) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last,
count(DISTINCT value) AS d, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 6) AS var FROM events GROUP BY 1, 2""")
def window_aggregates(spark, sf):
    order = F.struct("ts", "version")
    a = lambda n: windows.aggregate(n, "value", order)
    out = windows.tumbling(features(spark, sf), "1 day", ["entity"], {"n": a("count"), "s": R(a("sum")), "a": R(a("avg")), "lo": a("min"), "hi": a("max"), "first": a("first"), "last": a("last"), "d": a("distinct"), "p95": R(a("p95")), "sd": R(a("stddev")), "var": R(a("variance"))})
    return out.withColumn("window_start", micros("window_start")).drop("window_end")


@query("op_A06_first_last", "SELECT user_id AS entity, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def first_last(spark, sf):
    return features(spark, sf).groupBy("entity").agg(windows.aggregate("first", "value", F.col("version")).alias("first"), windows.aggregate("last", "value", F.col("version")).alias("last"))


@query("op_A07_window_group_stddev", "SELECT event_type AS feature, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS window_start, count(*) AS n, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1, 2")
def window_group_stddev(spark, sf):
    out = windows.tumbling(features(spark, sf), "6 hours", ["feature"], {"n": F.count("*"), "sd": R(F.stddev_pop("value"))})
    return out.withColumn("window_start", micros("window_start")).drop("window_end")


@query("op_A08_horizontal", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 6) AS s, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo, round((l_discount + l_tax) / 2, 6) AS a, 2 AS n FROM lineitem")
def horizontal(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in sets.horizontal(["l_discount", "l_tax"]).items()])


@query("op_A09_recent_aggregate", "SELECT user_id AS entity, round(sum(value), 6) AS s FROM events WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def recent_aggregate(spark, sf):
    h = features(spark, sf).filter("ts > timestamp'2024-01-13 00:00:00' and ts <= timestamp'2024-01-15 00:00:00'")
    return h.groupBy("entity").agg(R(F.sum("value")).alias("s"))


@query("op_A10_column_stats", "SELECT min(value) AS lo, max(value) AS hi, count(*) - count(value) AS nulls, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def column_stats(spark, sf):
    return load(spark, sf, "events").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("op_A11_consistency_report", "SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN d > 0.02 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(d), 6) AS mean, max(d) AS worst, round(stddev_pop(d), 6) AS sd, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.99), 6) AS p99 FROM (SELECT l_returnflag, round(abs(l_discount - l_tax), 6) AS d FROM lineitem) GROUP BY 1")
def consistency_report(spark, sf):
    d = load(spark, sf, "lineitem").select("l_returnflag", R(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("d"))
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), R(F.avg((F.col("d") > 0.02).cast("double"))).alias("rate"), R(F.avg("d")).alias("mean"), F.max("d").alias("worst"), R(F.stddev_pop("d")).alias("sd"), R(F.percentile("d", F.lit(0.5))).alias("p50"), R(F.percentile("d", F.lit(0.99))).alias("p99"))


@query("op_A12_snapshot_histogram", "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1")
def snapshot_histogram(spark, sf):
    return sets.histogram(load(spark, sf, "events"), "value", 10)


@query("op_A12_snapshot_percentiles", "SELECT round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(DISTINCT value) AS uniq FROM events")
def snapshot_percentiles(spark, sf):
    ps = F.percentile("value", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)]))
    out = load(spark, sf, "events").agg(ps.alias("p"), F.count_distinct("value").alias("uniq"))
    return out.select(*[R(F.col("p")[i]).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95", "p99"))], "uniq")


@query("op_A14_change_metrics", "SELECT feature, count(*) AS n, round(avg(gap), 4) AS mean_gap, round(avg(CASE WHEN changed THEN 1.0 ELSE 0.0 END), 6) AS change_rate FROM (SELECT event_type AS feature, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, value <> lag(value) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE gap IS NOT NULL GROUP BY 1")
def change_metrics(spark, sf):
    w = Window.partitionBy("entity", "feature").orderBy("ts", "version")
    h = features(spark, sf).withColumn("gap", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6).withColumn("changed", F.col("value") != F.lag("value").over(w)).filter("gap is not null")
    return h.groupBy("feature").agg(F.count("*").alias("n"), R(F.avg("gap"), 4).alias("mean_gap"), R(F.avg(F.col("changed").cast("double"))).alias("change_rate"))


@query("op_W01_rolling_sum", "SELECT event_id AS version, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS s FROM events")
def rolling_sum(spark, sf):
    return features(spark, sf).select("version", R(F.sum("value").over(windows.rolling(["entity"], 3600))).alias("s"))


@query("op_W02_first_last_over", "SELECT event_id AS version, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events")
def first_last_over(spark, sf):
    w = Window.partitionBy("entity").orderBy("ts", "version")
    return features(spark, sf).select("version", F.first("value").over(w).alias("first"), F.last("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))


@query("op_O01_order_by", "SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 25")
def order_by(spark, sf):
    top = load(spark, sf, "customer").orderBy("c_mktsegment", F.col("c_acctbal").desc(), "c_custkey").limit(25)
    return top.select("c_custkey", F.row_number().over(Window.orderBy("c_mktsegment", F.col("c_acctbal").desc(), "c_custkey")).alias("rank"))


@query("op_O02_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit(spark, sf):
    return load(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey")


@query("op_O04_top_bottom", "SELECT c_nationkey, c_custkey, side FROM (SELECT c_nationkey, c_custkey, 'top' AS side, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer UNION ALL SELECT c_nationkey, c_custkey, 'bottom', row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) FROM customer) WHERE r <= 3")
def top_bottom(spark, sf):
    c = load(spark, sf, "customer")
    return sets.top(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", F.lit("top").alias("side")).unionByName(sets.top(c, ["c_nationkey"], [F.col("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", F.lit("bottom").alias("side")))


@query("op_U01_deduplicate", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type, floor(epoch(ts) / 3600)")
def deduplicate(spark, sf):
    e = load(spark, sf, "events").withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))
    return e.groupBy("user_id", "event_type", "hour").agg(F.min("event_id").alias("event_id")).drop("hour")


@query("op_U02_snapshot_diff", """WITH a AS (SELECT user_id AS k, sum(event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT user_id AS k, sum(event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-11' AND user_id % 9 <> 4 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark, sf):
    e = load(spark, sf, "events")
    snap = lambda f: e.filter(f).groupBy(F.col("user_id").alias("k")).agg(F.sum("event_id").alias("v"))
    return sets.diff(snap("ts < timestamp'2024-01-10 00:00:00'"), snap("ts < timestamp'2024-01-11 00:00:00' and user_id % 9 <> 4"), "k", "v")


@query("op_U03_version_merge", "SELECT user_id AS entity, event_type AS feature, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def version_merge(spark, sf):
    h = features(spark, sf)
    return sets.latest_wins([h.filter("feature = 'click'"), h.filter("feature = 'view'"), h.filter("feature = 'view' and version % 2 = 0")], ["entity", "feature"], "version").select("entity", "feature", "value")


@query("op_U04_merge_best", "SELECT user_id AS id, max(value) AS score FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def merge_best(spark, sf):
    e = load(spark, sf, "events")
    lists = [e.filter(F.col("event_type") == k).select(F.col("user_id").alias("id"), F.col("value").alias("score")) for k in ("click", "error")]
    return sets.best(lists, "id", "score")
