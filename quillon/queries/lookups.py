"""Queries S, K and P: lookups, writes, projection and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, lookups
from ..registry import query
from ..tables import as_of, features, load, micros

AT = "2024-01-16 00:00:00"
LAST = "SELECT user_id AS entity, event_type AS feature, arg_max(value, (ts, event_id)) AS value, epoch_us(max(ts)) AS ts FROM events {} GROUP BY 1, 2"


@query("op_S01_point_lookup", f"SELECT * FROM ({LAST.format('')}) WHERE entity IN (1, 2, 3)")
def point_lookup(spark, sf):
    return lookups.latest(features(spark, sf).filter(F.col("entity").isin(1, 2, 3))).withColumn("ts", micros("ts"))


@query("op_S02_as_of_lookup", LAST.format(f"WHERE ts <= TIMESTAMP '{AT}'"))
def as_of_lookup(spark, sf):
    return lookups.as_of(features(spark, sf), as_of(AT)).withColumn("ts", micros("ts"))


@query(
    "op_S03_batch_lookup",
    """SELECT e.entity, max(value) FILTER (feature = 'click') AS click, max(value) FILTER (feature = 'purchase') AS purchase
       FROM (SELECT unnest(range(0, 40)) AS entity) e LEFT JOIN (SELECT user_id, event_type AS feature, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) l ON l.user_id = e.entity GROUP BY 1""",
)
def batch_lookup(spark, sf):
    return lookups.batch(features(spark, sf), spark.range(40).withColumnRenamed("id", "entity"), ["click", "purchase"])


@query("op_S04_streaming_lookup", LAST.format(""))
def streaming_lookup_all(spark, sf):
    """All entities asked for."""
    return lookups.latest(features(spark, sf)).withColumn("ts", micros("ts"))


@query("op_S05_dataset_scan", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def dataset_scan(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", "value").orderBy("event_id").offset(100).limit(50)


@query("op_S06_entity_history", f"SELECT user_id AS entity, event_type AS feature, value, epoch_us(ts) AS ts, event_id AS version FROM events WHERE user_id = 3 AND ts <= TIMESTAMP '{AT}'")
def entity_history(spark, sf):
    return lookups.entity_history(features(spark, sf), 3, as_of(AT)).withColumn("ts", micros("ts"))


@query("op_S18_ticket_scan", "SELECT user_id, event_type, value FROM events WHERE user_id IN (1, 2, 5) AND value > 10")
def ticket_scan(spark, sf):
    return filters.scan(load(spark, sf, "events"), ["user_id", "event_type", "value"], [("user_id", "in", [1, 2, 5]), ("value", "gt", 10)])


@query("op_S19_batch_serving", "SELECT e.c_custkey AS entity, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS spent FROM customer e LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def batch_serving_all(spark, sf):
    """All customers asked for."""
    return _served(spark, sf, load(spark, sf, "customer"))


def _served(spark, sf, customers):
    asked = customers.select(F.col("c_custkey").alias("entity"))
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", "o_totalprice")
    return asked.join(orders, "entity", "left").groupBy("entity").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("op_S20_backfill_seek", "SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def backfill_seek(spark, sf):
    return load(spark, sf, "events").filter((F.col("ts") >= as_of("2024-01-10 00:00:00")) & (F.col("ts") < as_of("2024-01-12 00:00:00"))).select("event_id", "user_id", "value")


@query("op_K01_versioned_put", "SELECT user_id AS entity, event_type AS feature, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY 1, 2")
def versioned_put(spark, sf):
    return lookups.put(features(spark, sf)).select("entity", "feature", "value", "version")


@query(
    "op_K04_ttl_expiry",
    f"""SELECT * FROM ({LAST.format('')}) WHERE feature NOT IN ('click', 'view') OR feature = 'click' AND ts >= epoch_us(TIMESTAMP '2024-01-31') - 172800000000 OR feature = 'view' AND ts >= epoch_us(TIMESTAMP '2024-01-31') - 432000000000""",
)
def ttl_expiry(spark, sf):
    current = lookups.latest(features(spark, sf))
    return lookups.unexpired(current, as_of("2024-01-31 00:00:00"), {"click": 2 * 86400, "view": 5 * 86400}).withColumn("ts", micros("ts"))


@query("op_K05_delete_entities", "SELECT event_id, user_id AS entity FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)")
def delete_entities(spark, sf):
    history = load(spark, sf, "events").select("event_id", F.col("user_id").alias("entity"), "event_type", "value")
    gone = history.filter("event_type = 'error' and value > 50").select("entity").distinct()
    return lookups.without_entities(history, gone).select("event_id", "entity")


CONFLICT = """WITH s AS (SELECT user_id AS entity, arg_max(value, event_id) AS value, epoch_us(max(ts)) AS ts, max(event_id) % 7 AS version FROM events WHERE event_type = 'click' GROUP BY 1),
t AS (SELECT user_id AS entity, arg_max(value, event_id) AS value, epoch_us(max(ts)) AS ts, max(event_id) % 7 AS version FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(s.entity, t.entity) AS entity, CASE WHEN {0} THEN s.value ELSE t.value END AS value, CASE WHEN {0} THEN s.ts ELSE t.ts END AS ts, CASE WHEN {0} THEN s.version ELSE t.version END AS version FROM s FULL JOIN t ON s.entity = t.entity"""


def _sides(spark, sf):
    side = lambda kind: features(spark, sf).filter(F.col("feature") == kind).groupBy("entity").agg(F.max_by("value", "version").alias("value"), F.unix_micros(F.max("ts")).alias("ts"), (F.max("version") % 7).alias("version"))
    return side("click"), side("view")


@query("op_K12_conflict_latest", CONFLICT.format("t.entity IS NULL OR s.ts > t.ts"))
def conflict_latest(spark, sf):
    return lookups.resolved(*_sides(spark, sf), "latest")


@query("op_K12_conflict_version", CONFLICT.format("t.entity IS NULL OR s.version > t.version OR s.version = t.version AND s.ts > t.ts"))
def conflict_version(spark, sf):
    return lookups.resolved(*_sides(spark, sf), "higher_version")


@query("op_K15_subscription", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND user_id IN (1, 2, 3, 4)")
def subscription(spark, sf):
    return filters.subscribed(features(spark, sf), names=["click", "purchase"], entities=[1, 2, 3, 4]).select(F.col("version").alias("event_id"))


@query("op_K07_point_in_time_export", """SELECT s.entity, s.day, p.value AS purchase
FROM (SELECT entity, day, TIMESTAMP '2024-01-01' + to_days(day::INT) AS at FROM (SELECT DISTINCT user_id AS entity FROM events), (SELECT unnest([5, 10, 20]) AS day)) s
ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON p.user_id = s.entity AND p.ts <= s.at""")
def point_in_time_export_all(spark, sf):
    """All entities asked for."""
    return _exported(features(spark, sf))


def _exported(history):
    from ..operators import joins

    days = F.explode(F.array(*[F.lit(d) for d in (5, 10, 20)]))
    spine = history.select("entity").distinct().select("entity", days.alias("day")).withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, day)"))
    out = joins.point_in_time(spine, history.filter("feature = 'purchase'"), ["entity"], ["value"], how="left", tie=["version"])
    return out.select("entity", "day", F.col("value").alias("purchase"))


@query("op_P02_where_and_or", "SELECT event_id FROM events WHERE (event_type = 'click' AND value > 50) OR (event_type = 'purchase' AND value <= 20)")
def where_and_or(spark, sf):
    tree = ("or", ("and", ("event_type", "=", "click"), ("value", ">", 50)), ("and", ("event_type", "=", "purchase"), ("value", "<=", 20)))
    return load(spark, sf, "events").filter(filters.condition(tree)).select("event_id")


@query("op_P03_having", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60")
def having(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 60")


@query("op_P06_filter_processor", "SELECT event_id FROM events WHERE value >= 42.5 AND event_type <> 'error'")
def filter_processor(spark, sf):
    return load(spark, sf, "events").filter(filters.predicate("value", "gte", 42.5) & filters.predicate("event_type", "ne", "error")).select("event_id")


@query("op_P07_pattern_predicates", "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND starts_with(p_brand, 'Brand') AND NOT p_size IN (1, 2, 3) AND regexp_matches(p_type, '^[A-Z]')")
def pattern_predicates(spark, sf):
    rules = [("p_name", "contains", "a"), ("p_brand", "starts_with", "Brand"), ("p_size", "not_in", [1, 2, 3]), ("p_type", "regex", "^[A-Z]")]
    return filters.scan(load(spark, sf, "part"), ["p_partkey"], rules)


@query(
    "op_P08_transforms",
    """SELECT event_id AS id, upper(event_type) AS kind, coalesce(try_cast(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT), -1) AS k, event_type || '-' || user_id AS label, string_split(event_type || '_x', '_')[1] AS part FROM events""",
)
def transforms(spark, sf):
    steps = [("rename", "event_id", "id"), ("extract", "props", "k", '"k": ([0-9]+)'), ("cast", "k", "long"), ("default", "k", -1), ("concat", "label", ["event_type", "user_id"], "-"), ("compute", "kind", "upper(event_type)"), ("compute", "part", "split(concat(event_type, '_x'), '_')[0]")]
    return filters.transformed(load(spark, sf, "events"), steps).select("id", "kind", "k", "label", "part")


@query("op_P09_router", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'money' WHEN 'error' THEN 'alerts' ELSE 'default' END AS route FROM events")
def router(spark, sf):
    return load(spark, sf, "events").select("event_id", filters.route([("event_type", "purchase", "money"), ("event_type", "error", "alerts")], "default").alias("route"))


@query("op_P10_enrich", "SELECT o_orderkey, c_name, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def enrich(spark, sf):
    lookup = load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_mktsegment").alias("segment"))
    out = load(spark, sf, "orders").join(lookup, "o_custkey", "left")
    return out.select("o_orderkey", "c_name", F.coalesce("segment", F.lit("none")).alias("segment"))


@query("op_P11_pushed_predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_shipdate IS NOT NULL AND l_returnflag <> 'N' AND l_linenumber <= 3")
def pushed_predicates(spark, sf):
    return filters.scan(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [("l_quantity", "gte", 45), ("l_shipdate", "not_null", None), ("l_returnflag", "ne", "N"), ("l_linenumber", "lte", 3)])


@query("op_P12_first_passing", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_discount WHEN l_tax > 0.05 THEN l_tax END AS passed FROM lineitem")
def first_passing(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", filters.first_passing(["l_discount", "l_tax"], "gt", 0.05).alias("passed"))


@query("op_P13_targeting", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 100 AND NOT c_nationkey = 3")
def targeting(spark, sf):
    return filters.scan(load(spark, sf, "customer"), ["c_custkey"], [("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), ("c_acctbal", "gte", 100), ("c_nationkey", "neq", 3)])


@query("op_P14_validation", "SELECT l_returnflag, count(*) FILTER (WHERE NOT (l_quantity BETWEEN 5 AND 45)) AS bad_quantity, count(*) FILTER (WHERE NOT (l_returnflag IN ('A', 'R'))) AS bad_flag FROM lineitem GROUP BY 1")
def validation(spark, sf):
    checked = load(spark, sf, "lineitem").withColumn("reasons", filters.violations({"l_quantity": {"min": 5, "max": 45, "not_null": True}, "l_returnflag": {"one_of": ["A", "R"], "regex": "^[A-Z]$"}}))
    n = lambda r: F.count_if(F.array_contains("reasons", r))
    return checked.groupBy("l_returnflag").agg((n("l_quantity:min") + n("l_quantity:max")).alias("bad_quantity"), n("l_returnflag:one_of").alias("bad_flag"))


@query("op_P15_metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def metadata_filter(spark, sf):
    return filters.by_metadata(load(spark, sf, "documents").withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))), {"lang": "en", "source": "src1"}).select("doc_id")
