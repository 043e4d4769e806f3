"""Queries of sources, sinks, maintenance and facades: round trips through files, materialisation, catalogs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..functions import vectors as V
from ..functions.expressions import compiled
from ..operators import filters, maintenance
from ..plans import catalog, composition, streamsql
from ..registry import query
from ..shared import new_path
from ..sources import files
from ..tables import features, load, micros
from .statistics import BINS, halves, rounded
from .vectors import BAG


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return new_path(spark, "files")


def through(df, fmt, schema=None, partition_by=None):
    path = scratch(df.sparkSession)
    files.write(df, path, fmt, partition_by=partition_by)
    return files.read(df.sparkSession, path, "jsonl" if fmt == "json" else fmt, schema)


NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("op_S07_csv_import", "SELECT n_name AS entity, feature, value FROM (SELECT n_name, n_nationkey::VARCHAR AS n_nationkey, n_regionkey::VARCHAR AS n_regionkey FROM nation) UNPIVOT (value FOR feature IN (n_nationkey, n_regionkey))")
def csv_import(spark, sf):
    rows = through(load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "csv")
    return files.features_of(rows, "n_name", None, F.lit("2024-01-01").cast("timestamp")).select("entity", "feature", "value")


@query("op_S08_json_import", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_import(spark, sf):
    return through(load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "json", NATION)


@query("op_S09_jsonl_import", "SELECT event_id, user_id, event_type, value FROM events")
def jsonl_import(spark, sf):
    return through(load(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "jsonl", "event_id long, user_id long, event_type string, value double")


@query("op_S12_connector_merge", "SELECT user_id AS entity, event_type AS feature, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def connector_merge(spark, sf):
    h = features(spark, sf)
    old = through(h.filter("version % 2 = 0"), "parquet")
    return files.merge(old, h.filter("version % 2 = 1")).select("entity", "feature", "value")


@query("op_K06_export_parquet", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def export_parquet(spark, sf):
    return through(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "parquet")


@query("op_K06_export_orc", "SELECT p_partkey, p_size FROM part")
def export_orc(spark, sf):
    return through(load(spark, sf, "part").select("p_partkey", "p_size"), "orc")


@query("op_K08_partitioned_writer", "SELECT user_id AS entity, event_id AS version FROM events WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08'")
def partitioned_writer(spark, sf):
    path = scratch(spark)
    files.export_partitioned(features(spark, sf), path, "user")
    return spark.read.parquet(path).filter("entity_type = 'user' and date = date'2024-01-07'").select("entity", "version")


@query("op_K09_append", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def append(spark, sf):
    path, e = scratch(spark), load(spark, sf, "events")
    for kind in ("click", "view"):
        files.write(e.filter(F.col("event_type") == kind).select("event_id"), path, "parquet", "append")
    return files.read(spark, path, "parquet")


@query("op_S17_object_range", "SELECT 4::BIGINT AS n, 'PAR1' AS magic")
def object_range(spark, sf):
    """First bytes of a Parquet file, read as an object."""
    b = files.blobs(spark, f"{sf}/region.parquet", 0, 4)
    return b.select(F.length("content").cast("long").alias("n"), F.decode("content", "UTF-8").alias("magic"))


@query("op_S22_field_resolver", "SELECT user_id AS entity, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' AND user_id IN (2, 4, 6) GROUP BY 1")
def field_resolver(spark, sf):
    return catalog.resolve(features(spark, sf), "{ feature(name: view, entities: [2, 4, 6]) }").select("entity", "value")


@query("op_A13_aggregate_resolver", "SELECT user_id AS entity, round(sum(value), 6) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def aggregate_resolver(spark, sf):
    return catalog.resolve(features(spark, sf), "{ aggregation(name: click, function: sum) }").select("entity", F.round("value", 6).alias("value"))


@query("op_S23_view_references", "SELECT e.entity, max(value) FILTER (feature = 'click') AS click, max(value) FILTER (feature = 'error') AS error FROM (SELECT unnest([1, 2, 3]) AS entity) e LEFT JOIN (SELECT user_id, event_type AS feature, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) l ON l.user_id = e.entity GROUP BY 1")
def view_references(spark, sf):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "entity int")
    return catalog.online(features(spark, sf), asked, ["user_view:click", "user_view:error"])


@query("op_J12_native_sql", "SELECT n_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 2")
def native_sql(spark, sf):
    for t in ("customer", "nation"):
        load(spark, sf, t).createOrReplaceTempView(f"quillon_{t}")
    return spark.sql("SELECT n_name, count(*) AS n FROM quillon_customer LEFT JOIN quillon_nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 2")


@query("op_P01_projection", "SELECT event_id AS id, event_type AS kind, value FROM events")
def projection(spark, sf):
    return streamsql.execute("SELECT event_id AS id, event_type AS kind, value FROM e", {"e": load(spark, sf, "events")})


@query("op_P04_arithmetic_projection", "SELECT event_id, round(value + user_id, 6) AS a, CASE WHEN user_id = 0 THEN NULL ELSE round(value / user_id, 6) END AS b FROM events")
def arithmetic_projection(spark, sf):
    return load(spark, sf, "events").select("event_id", F.round(compiled("value + user_id", "template"), 6).alias("a"), F.round(compiled("value / user_id", "template"), 6).alias("b"))


@query("op_P05_where_tree", "SELECT event_id FROM events WHERE (value > 50 OR event_type = 'error') AND NOT user_id < 5")
def where_tree(spark, sf):
    return streamsql.execute("SELECT event_id FROM e WHERE (value > 50 OR event_type = 'error') AND NOT user_id < 5", {"e": load(spark, sf, "events")})


@query("op_F16_ternary", "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS v FROM events")
def ternary(spark, sf):
    return load(spark, sf, "events").select("event_id", compiled("value > 50 ? 'high' : 'low'", "template").alias("v"))


@query("op_F19_assignments", "SELECT event_id, round(value + user_id, 6) AS total, upper(event_type) AS kind FROM events")
def assignments(spark, sf):
    out = composition.assigned(load(spark, sf, "events"), "total = sum(value, user_id)\nkind = upper(event_type)")
    return out.select("event_id", F.round("total", 6).alias("total"), "kind")


@query("op_M31_jensen_shannon_floor", BINS.format(20) + ", s AS (SELECT greatest(r / nr, 1e-10) AS p, greatest(c / nc, 1e-10) AS q FROM t) SELECT round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 6) AS js FROM s")
def jensen_shannon_floor(spark, sf):
    return rounded(S.divergences(*halves(spark, sf), "value", bins=20).select("js"))


@query("op_M39_audit_root", """WITH RECURSIVE l(k, i, d) AS (
SELECT 0, row_number() OVER (ORDER BY event_id) - 1, unhex(sha256('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}')) FROM events
UNION ALL SELECT k + 1, i // 2, unhex(sha256(arg_min(d, i) || arg_max(d, i))) FROM l WHERE k < (SELECT ceil(log2(count(*))) FROM events) GROUP BY k, i // 2)
SELECT (SELECT count(*) FROM events) AS n, lower(hex(d)) AS root FROM l WHERE k = (SELECT ceil(log2(count(*))) FROM events)""")
def audit_root(spark, sf):
    return maintenance.merkle_root(load(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("body")), "event_id", "body")


@query("op_N01_interval_materialization", "SELECT event_type, epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day, count(*) AS n, round(sum(value), 6) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08' GROUP BY 1, 2")
def interval_materialization(spark, sf):
    e = load(spark, sf, "events")
    build = lambda rows: rows.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("s"))
    path = scratch(spark)
    maintenance.backfilled(e, build, "ts", "2024-01-03", "2024-01-08", 86400, path)
    return spark.read.parquet(path).select("event_type", micros("day").alias("day"), "n", "s")


@query("op_N02_dirty_recompute", "SELECT user_id % 10 AS part, count(*) AS n, round(sum(CASE WHEN user_id % 10 = 3 THEN value * 2 ELSE value END), 4) AS s FROM events GROUP BY 1")
def dirty_recompute(spark, sf):
    """Only the parts whose rows changed are computed again."""
    e = load(spark, sf, "events").withColumn("part", F.col("user_id") % 10)
    build = lambda rows: rows.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))
    changed = e.withColumn("value", F.when(F.col("part") == 3, F.col("value") * 2).otherwise(F.col("value")))
    return maintenance.recomputed(build(e), changed, changed.filter("part = 3").select("part").distinct(), "part", build)


@query("op_N07_schema_merge", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 10 THEN n_regionkey END AS n_regionkey FROM nation")
def schema_merge(spark, sf):
    path, n = scratch(spark), load(spark, sf, "nation")
    files.write(n.filter("n_nationkey < 10").select("n_nationkey", "n_name"), path, "parquet")
    files.write(n.filter("n_nationkey >= 10").select("n_nationkey", "n_name", "n_regionkey"), path, "parquet", "append")
    return spark.read.option("mergeSchema", True).parquet(path).select("n_nationkey", "n_name", "n_regionkey")


COSINE = "round(list_dot_product(b, q) / (sqrt(list_dot_product(b, b)) * sqrt(list_dot_product(q, q))), 6)"
PIECES = "SELECT item_id, pos, chunk FROM (SELECT item_id, pos::INT AS pos, text[pos * 250 + 1 : pos * 250 + 300] AS chunk FROM (SELECT item_id, text, unnest(range(0, greatest(ceil((length(text) - 50) / 250.0)::BIGINT, 1))) AS pos FROM benchmark WHERE length(text) > 0))"


@query("op_X15_retrieval", f"SELECT item_id, pos, round(1 - coalesce({COSINE}, 0), 6) AS distance FROM (SELECT item_id, pos, {BAG.format('chunk')} AS b FROM ({PIECES})), (SELECT {BAG.format(repr('the of and'))} AS q) ORDER BY distance, item_id, pos LIMIT 5")
def retrieval(spark, sf):
    """The chunks nearest to a question, by hashed bags of words."""
    chunks = V.chunks(load(spark, sf, "benchmark"), 300, 50, "item_id").withColumn("v", V.hash_embedding(F.col("chunk")))
    asked = V.hash_embedding(F.lit("the of and"))
    return chunks.select("item_id", "pos", F.round(V.cosine_distance(F.col("v"), asked), 6).alias("distance")).orderBy("distance", "item_id", "pos").limit(5)


@query("op_X15_filtered_retrieval", f"SELECT item_id, pos, round(1 - coalesce({COSINE}, 0), 6) AS distance FROM (SELECT item_id, pos, {BAG.format('chunk')} AS b FROM ({PIECES}) WHERE item_id % 2 = 1), (SELECT {BAG.format(repr('the of and'))} AS q) ORDER BY distance, item_id, pos LIMIT 5")
def filtered_retrieval(spark, sf):
    """Retrieval among the chunks whose metadata fit."""
    chunks = V.chunks(load(spark, sf, "benchmark"), 300, 50, "item_id").withColumn("metadata", F.create_map(F.lit("odd"), (F.col("item_id") % 2).cast("string")))
    some = filters.by_metadata(chunks, {"odd": "1"}).withColumn("v", V.hash_embedding(F.col("chunk")))
    return some.select("item_id", "pos", F.round(V.cosine_distance(F.col("v"), V.hash_embedding(F.lit("the of and"))), 6).alias("distance")).orderBy("distance", "item_id", "pos").limit(5)


@query("op_X12_semantic_search", f"SELECT item_id, {COSINE} AS score FROM (SELECT item_id, {BAG.format('text')} AS b FROM benchmark), (SELECT {BAG.format(repr('in the'))} AS q) WHERE {COSINE} > 0.1 ORDER BY score DESC, item_id LIMIT 10")
def semantic_search(spark, sf):
    docs = load(spark, sf, "benchmark").withColumn("v", V.hash_embedding(F.col("text")))
    return docs.select("item_id", F.round(1 - V.cosine_distance(F.col("v"), V.hash_embedding(F.lit("in the"))), 6).alias("score")).filter("score > 0.1").orderBy(F.col("score").desc(), "item_id").limit(10)


@query("op_X12_duplicates", f"SELECT a.item AS a, b.item AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine, round(1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)), 6) AS name FROM (SELECT p_partkey AS item, p_type AS name, {BAG.format('p_name')} AS v FROM part) a, (SELECT p_partkey AS item, p_type AS name, {BAG.format('p_name')} AS v FROM part) b WHERE a.item < b.item AND cosine >= 0.6 AND 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.5")
def duplicates(spark, sf):
    """Parts alike in their hashed names and in their types."""
    p = load(spark, sf, "part").withColumn("v", V.hash_embedding(F.col("p_name")))
    return V.duplicates(p, "p_partkey", "p_type", "v", 0.6, 0.5)
