"""Queries V, X, G, N: vectors, text, graphs, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graphs
from ..plans import composition
from ..registry import query
from ..tables import features, load


def first_vector(spark, sf):
    return load(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


@query("op_V01_distances", "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS cosine, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS euclid, round(-list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS dot FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)")
def distances(spark, sf):
    q = F.broadcast(load(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q")))
    e = load(spark, sf, "embeddings").crossJoin(q)  # one row
    return e.select("vec_id", *[F.round(V.DISTANCES[m](F.col("embedding"), F.col("q")), 6).alias(n) for n, m in (("cosine", "cosine"), ("euclid", "euclidean"), ("dot", "dot"))])


@query("op_V02_nearest", "SELECT vec_id, distance FROM (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) ORDER BY distance, vec_id LIMIT 10")
def nearest(spark, sf):
    return V.nearest(load(spark, sf, "embeddings"), first_vector(spark, sf), 10)


@query("op_O03_vector_top_k", "SELECT vec_id, distance FROM (SELECT vec_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) ORDER BY distance, vec_id LIMIT 5")
def vector_top_k(spark, sf):
    return V.nearest(load(spark, sf, "embeddings"), first_vector(spark, sf), 5, "euclidean")


@query("op_V03_scalar_quantiser", "WITH p AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), b AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM p GROUP BY 1) SELECT vec_id, p.pos::INT AS pos, floor((x - lo)::DOUBLE / (hi - lo)::DOUBLE * 255)::INT AS code FROM p JOIN b ON b.pos = p.pos")
def scalar_quantiser(spark, sf):
    return V.quantised(load(spark, sf, "embeddings"))


@query("op_V04_inverted_lists", "SELECT vec_id, distance FROM (SELECT vec_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)) ORDER BY distance, vec_id LIMIT 10")
def inverted_lists(spark, sf):
    return V.InvertedLists(load(spark, sf, "embeddings")).search(first_vector(spark, sf), 10)


@query("op_V04_product_quantiser", """WITH p AS (SELECT vec_id, part, embedding[part * 8 + 1 : part * 8 + 8]::DOUBLE[] AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 8)) AS part FROM embeddings)),
c AS (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM p QUALIFY k < 16),
n AS (SELECT p.vec_id, p.part, arg_min(k, (list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k)) AS code FROM p JOIN c ON c.part = p.part GROUP BY 1, 2)
SELECT vec_id, list(code::INT ORDER BY part) AS codes FROM n GROUP BY 1""")
def product_quantiser(spark, sf):
    e = load(spark, sf, "embeddings")
    return V.ProductQuantiser(e, parts=8).codes(e)


@query("op_V05_embedding_drift", "WITH p AS (SELECT label < 5 AS side, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT side, pos, avg(x) AS m FROM p GROUP BY 1, 2), v AS (SELECT a.m AS a, b.m AS b FROM m a JOIN m b ON a.pos = b.pos AND a.side AND NOT b.side) SELECT round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS drift FROM v")
def embedding_drift(spark, sf):
    e = load(spark, sf, "embeddings")
    a, b = V.mean_vector(e.filter("label < 5")).withColumnRenamed("mean", "a"), V.mean_vector(e.filter("label >= 5")).withColumnRenamed("mean", "b")
    return a.crossJoin(b).select(F.round(V.cosine_distance(F.col("a"), F.col("b")), 6).alias("drift"))


@query("op_X10_chunks", "SELECT doc_id, pos::INT AS pos, text[pos * 160 + 1 : pos * 160 + 200] AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 40) / 160.0)::BIGINT, 1))) AS pos FROM documents WHERE length(text) > 0)")
def chunk(spark, sf):
    return V.chunks(load(spark, sf, "documents"), 200, 40)


@query("op_X10_paragraphs", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, chunk FROM (SELECT doc_id, unnest(p) AS chunk, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS p FROM documents)) WHERE length(trim(chunk, ' ')) > 0")
def paragraph(spark, sf):
    return V.paragraphs(load(spark, sf, "documents"))


@query("op_X10_sentences", """SELECT doc_id, (i - 1)::INT AS pos, chunk FROM (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS i FROM (SELECT item_id AS doc_id, list_reduce(list_transform(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0), lambda s: [s]),
lambda a, b: CASE WHEN length(a[len(a)]) + 1 + length(b[1]) <= 200 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || b[1]) ELSE list_concat(a, b) END) AS c FROM benchmark WHERE length(text) > 0))""")
def sentence(spark, sf):
    return V.sentences(load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"))


#: A text's bag of 64 hashed words, not yet at unit length.
BAG = "(SELECT list_transform(range(0, 64), lambda k: len(list_filter(pl, lambda p: p = k))::DOUBLE) FROM (SELECT list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS pl))"


@query("op_X11_hash_embedding", f"SELECT item_id, list_transform(b, lambda x: round(x / greatest(sqrt(list_dot_product(b, b)), 1e-300), 9)) AS v FROM (SELECT item_id, {BAG.format('text')} AS b FROM benchmark)")
def hash_embedding(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", F.transform(V.hash_embedding(F.col("text")), lambda x: F.round(x, 9)).alias("v"))


@query("op_X12_similar_names", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND 1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)) > 0.4")
def similar_names(spark, sf):
    """Names are compared within a table of fixed size."""
    n = load(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).filter(V.similar_names(F.col("a"), F.col("b")) > 0.4).select("a", "b")


@query("op_X13_hybrid_ranking", "SELECT p_partkey, round(0.5 * p_retailprice / mp + 0.3 * p_size / ms + 0.2 * CASE WHEN contains(p_name, 'a') THEN 1 ELSE 0 END, 6) AS score FROM part, (SELECT max(p_retailprice) AS mp, max(p_size) AS ms FROM part)")
def hybrid_ranking(spark, sf):
    p = load(spark, sf, "part")
    m = F.broadcast(p.agg(F.max("p_retailprice").alias("mp"), F.max("p_size").alias("ms")))
    return p.crossJoin(m).select("p_partkey", F.round(0.5 * F.col("p_retailprice") / F.col("mp") + 0.3 * F.col("p_size") / F.col("ms") + 0.2 * F.col("p_name").contains("a").cast("int"), 6).alias("score"))


@query("op_X14_recommendation", """WITH s AS (SELECT user_id, event_type FROM events WHERE value > 60 GROUP BY 1, 2), n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1)
SELECT a.user_id AS u, b.user_id AS v, round(count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS sim FROM s a JOIN s b ON a.event_type = b.event_type AND a.user_id < b.user_id JOIN n x ON x.user_id = a.user_id JOIN n y ON y.user_id = b.user_id GROUP BY 1, 2""")
def recommendation_all(spark, sf):
    """Pairs of all users."""
    return V.similar_users(load(spark, sf, "events").filter("value > 60"), "user_id", "event_type")


@query("op_X16_strip_tags", "SELECT page_id, replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', '') AS t FROM pages")
def strip_tags(spark, sf):
    return load(spark, sf, "pages").select("page_id", V.without_tags(F.col("html")).alias("t"))


EDGES = "(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"
#: Lines of one order and number are one node.
EDGES_ALL = EDGES[:-1] + " UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM lineitem)"


def _edges(df, a, x, b, *y):
    name = [part for c in y for part in (F.lit("-"), F.col(c).cast("string"))][1:]
    return df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), *name).alias("dst"))


def edges(spark, sf):
    n, c = load(spark, sf, "nation"), load(spark, sf, "customer")
    return _edges(n, "r", "n_regionkey", "n", "n_nationkey").unionByName(_edges(c, "n", "c_nationkey", "c", "c_custkey"))


def edges_all(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    lines = _edges(li, "o", "l_orderkey", "l", "l_orderkey", "l_linenumber").distinct()
    return edges(spark, sf).unionByName(_edges(o, "c", "o_custkey", "o", "o_orderkey")).unionByName(lines)


@query("op_G01_closure", f"WITH RECURSIVE t(start, node, depth) AS (SELECT DISTINCT src, dst, 1 FROM {EDGES_ALL} WHERE src LIKE 'r%' UNION SELECT t.start, e.dst, t.depth + 1 FROM t JOIN {EDGES_ALL} e ON e.src = t.node) SELECT start, node, depth FROM t")
def closure_all(spark, sf):
    """The graph of all five tables."""
    e = edges_all(spark, sf)
    return graphs.reachable(e, e.filter("src like 'r%'").select(F.col("src").alias("node")).distinct())


@query("op_G03_blast_radius", f"WITH RECURSIVE t(start, node) AS (SELECT DISTINCT src, dst FROM {EDGES_ALL} WHERE src LIKE 'r%' UNION SELECT t.start, e.dst FROM t JOIN {EDGES_ALL} e ON e.src = t.node) SELECT start, count(*) AS affected, round(least(10, 10 * count(*)::DOUBLE / (SELECT count(*) FROM (SELECT src FROM {EDGES_ALL} UNION SELECT dst FROM {EDGES_ALL}))), 6) AS risk FROM t GROUP BY 1")
def blast_radius_all(spark, sf):
    """The graph of all five tables."""
    e = edges_all(spark, sf)
    return graphs.blast_radius(e, e.filter("src like 'r%'").select(F.col("src").alias("node")).distinct())


def rank_sql(edges: str, rounds: int = 10) -> str:
    """Page rank with its rounds written out."""
    sql = f"WITH e AS (SELECT * FROM {edges}), s AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM n)"
    for k in range(rounds):
        sql += f", r{k + 1} AS (SELECT n.node, 0.15 + 0.85 * coalesce(sum(rank * share), 0) AS rank FROM n LEFT JOIN (SELECT dst, rank, share FROM s JOIN r{k} ON node = src) ON dst = n.node GROUP BY 1)"
    return sql + f" SELECT node, round(rank / (SELECT max(rank) FROM r{rounds}), 6) AS score FROM r{rounds}"


@query("op_G04_centrality", rank_sql(EDGES_ALL))
def centrality(spark, sf):
    return graphs.centrality(edges_all(spark, sf)).select("node", F.round("score", 6).alias("score"))


@query("op_N03_compute_graph", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem")
def compute_graph(spark, sf):
    program = """
    SOURCE l_extendedprice, l_discount, l_tax
    DERIVE net AS l_extendedprice * (1 - l_discount) FROM l_extendedprice, l_discount
    DERIVE gross AS net * (1 + l_tax) FROM net, l_tax
    """
    out = composition.derived(load(spark, sf, "lineitem"), program)
    return out.select("l_orderkey", "l_linenumber", F.round("net", 6).alias("net"), F.round("gross", 6).alias("gross"))


@query("op_N04_composition", "SELECT c_custkey, round((c_acctbal + 1000) / 2, 4) AS half, upper(c_mktsegment) AS seg, round((c_acctbal + 1000) / 2 + 1, 4) AS more FROM customer")
def composed(spark, sf):
    nodes = {"plus": "c_acctbal + 1000", "half": "plus / 2", "seg": "upper(c_mktsegment)", "more": "half + 1"}
    out = composition.composed(load(spark, sf, "customer"), nodes, {"plus": [], "half": ["plus"], "seg": [], "more": ["half"]})
    return out.select("c_custkey", F.round("half", 4).alias("half"), "seg", F.round("more", 4).alias("more"))


@query("op_N05_backfill", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND value > 20 GROUP BY 1, 2, ts")
def backfill(spark, sf):
    e = load(spark, sf, "events").filter("ts >= timestamp'2024-01-05 00:00:00' and ts < timestamp'2024-01-20 00:00:00' and value > 20")
    return e.groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id")).drop("ts")


@query("op_N06_time_travel", "SELECT event_type AS feature, round(avg(value) FILTER (ts < TIMESTAMP '2024-01-10'), 6) AS before, round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-20'), 6) AS after, round(100 * (avg(value) FILTER (ts >= TIMESTAMP '2024-01-20') - avg(value) FILTER (ts < TIMESTAMP '2024-01-10')) / avg(value) FILTER (ts < TIMESTAMP '2024-01-10'), 6) AS pct FROM events GROUP BY 1")
def time_travel(spark, sf):
    a = F.avg(F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp"), F.col("value")))
    b = F.avg(F.when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"), F.col("value")))
    return features(spark, sf).groupBy("feature").agg(F.round(a, 6).alias("before"), F.round(b, 6).alias("after"), F.round(100 * (b - a) / a, 6).alias("pct"))


@query("op_N08_codec_choice", "SELECT 'l_returnflag' AS col, CASE WHEN count(DISTINCT l_returnflag) < 0.1 * count(*) THEN 'dictionary' ELSE 'plain' END AS codec FROM lineitem UNION ALL SELECT 'l_extendedprice', CASE WHEN count(DISTINCT l_extendedprice) < 0.1 * count(*) THEN 'dictionary' ELSE 'plain' END FROM lineitem")
def codec_choice(spark, sf):
    li = load(spark, sf, "lineitem")
    n = li.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in ("l_returnflag", "l_extendedprice")])
    rows = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.when(F.col(c) < 0.1 * F.col("n"), "dictionary").otherwise("plain").alias("codec")) for c in ("l_returnflag", "l_extendedprice")])).alias("r"))
    return rows.select("r.col", "r.codec")
