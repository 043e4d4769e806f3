"""Queries F: scalar functions and expression dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.expressions import compiled
from ..registry import query
from ..tables import load


def _li(spark, sf):
    return load(spark, sf, "lineitem")


def _expressions(df, keys, dialect="expr", digits=6, exact=(), **columns):
    """keys and columns, numbers rounded as the SQL rounds them; those named in exact are left as they are."""
    out = df
    cols = []
    for n, text in columns.items():
        c = compiled(text, dialect)
        cols.append((scalars.rounded(c, digits) if digits is not None and n not in exact and not text.startswith(("upper", "lower", "concat", "substr", "str(")) else c).alias(n))
    return out.select(*keys, *cols)


K = ["l_orderkey", "l_linenumber"]


@query("op_F01_math", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, ceil(l_extendedprice) AS b, floor(l_extendedprice) AS c, round(l_quantity / 4) AS d, round(sqrt(l_extendedprice), 6) AS e, l_quantity ** 2 AS f, round(ln(l_extendedprice), 6) AS g, round(log10(l_extendedprice), 6) AS h, round(exp(l_discount), 6) AS i FROM lineitem".replace("abs(l_discount - 0.05)", "round(abs(l_discount - 0.05), 6)"))
def math(spark, sf):
    return _expressions(_li(spark, sf), K, exact=("b", "c", "d", "f"), a="abs(l_discount - 0.05)", b="ceil(l_extendedprice)", c="floor(l_extendedprice)", d="round(l_quantity / 4)", e="sqrt(l_extendedprice)", f="pow(l_quantity, 2)", g="log(l_extendedprice)", h="log10(l_extendedprice)", i="exp(l_discount)")


@query("op_F02_min_max", "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax, 0.04) AS lo, greatest(l_discount, l_tax, 0.04) AS hi FROM lineitem")
def min_max(spark, sf):
    return _expressions(_li(spark, sf), K, exact=("lo", "hi"), lo="min(l_discount, l_tax, 0.04)", hi="max(l_discount, l_tax, 0.04)")


@query("op_F03_sum_avg_count", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 6) AS s, round((l_discount + l_tax) / 2, 6) AS a, 2.0 AS n FROM lineitem")
def sum_avg_count(spark, sf):
    return _expressions(_li(spark, sf), K, exact=("n",), s="sum(l_discount, l_tax, null)", a="avg(l_discount, l_tax, null)", n="count(l_discount, l_tax, null)")


@query("op_F04_len", "SELECT doc_id, octet_length(encode(text))::DOUBLE AS bytes, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents")
def length(spark, sf):
    return load(spark, sf, "documents").select("doc_id", compiled("len(text)").alias("bytes"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("op_F05_strings", "SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, p_name || '/' || p_brand AS both, p_type[3:6] AS part FROM part")
def strings(spark, sf):
    return _expressions(load(spark, sf, "part"), ["p_partkey"], lo="lower(p_name)", up="upper(p_brand)", both="concat(p_name, '/', p_brand)", part="substr(p_type, 2, 4)")


@query("op_F06_conditionals", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_tax < 0.05 THEN l_extendedprice ELSE 0 END AS a, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 2.0 END AS b FROM lineitem")
def conditionals(spark, sf):
    return _expressions(_li(spark, sf), K, exact=("a", "b"), a="if(l_quantity > 25 && l_tax < 0.05, l_extendedprice, 0)", b="l_returnflag == 'R' ? 1 : 2")


@query("op_F07_casts", "SELECT event_id, trunc(value)::BIGINT AS i, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS f, user_id::VARCHAR AS s FROM events")
def casts(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", compiled("int(value)").alias("i"), compiled("float(event_type)").alias("f"), compiled("str(user_id)").alias("s"))


@query("op_F08_scaling", "SELECT l_orderkey, l_linenumber, round((l_quantity - 25) / 10, 6) AS z, round((l_quantity - 1) / 49, 6) AS n, least(greatest(l_quantity, 10), 40) AS c, round(1 / (1 + exp(-l_discount)), 6) AS s, 0.5 AS e FROM lineitem")
def scaling(spark, sf):
    return _expressions(_li(spark, sf), K, exact=("c", "e"), z="zscore(l_quantity, 25, 10)", n="normalize(l_quantity, 1, 50)", c="clip(l_quantity, 10, 40)", s="sigmoid(l_discount)", e="normalize(l_quantity, 3, 3)")


@query("op_F09_softmax", "SELECT l_orderkey, l_linenumber, round(exp(l_discount) / (exp(l_discount) + exp(l_tax)), 6) AS p FROM lineitem")
def softmax(spark, sf):
    return _expressions(_li(spark, sf), K, p="softmax(l_discount, l_tax)[0]")


@query("op_F10_operators", "SELECT l_orderkey, l_linenumber, round(2 + l_quantity * 4, 6) AS a, l_quantity % 3 AS b, round(l_extendedprice / l_quantity, 6) AS c, -l_quantity AS d, CASE WHEN l_tax = 0 THEN 'Infinity'::DOUBLE ELSE round(1 / l_tax, 6) END AS e FROM lineitem")
def operators(spark, sf):
    return _expressions(_li(spark, sf), K, exact=("b", "d"), a="2 + l_quantity * 4", b="l_quantity % 3", c="l_extendedprice / l_quantity", d="-l_quantity", e="1 / l_tax")


@query("op_F11_indexing", "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[3]::DOUBLE AS third, NULL::DOUBLE AS beyond FROM embeddings")
def indexing(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", *[compiled(f"embedding[{i}]").cast("double").alias(n) for i, n in ((0, "first"), (2, "third"), (5000, "beyond"))])


@query("op_F12_precedence", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity > 10 AND l_tax < 0.02) OR l_returnflag = 'A' THEN round((l_quantity + 2) * 3 - 4.0 / 2, 6) ELSE -1 END AS v FROM lineitem")
def precedence(spark, sf):
    return _expressions(_li(spark, sf), K, v="l_quantity > 10 && l_tax < 0.02 || l_returnflag == 'A' ? (l_quantity + 2) * 3 - 4 / 2 : -1")


@query("op_F13_compute_dialect", "SELECT p_partkey, CASE WHEN contains(p_name, 'a') THEN length(p_name)::DOUBLE ELSE 0.0 END AS n, round(sqrt(p_size), 6) AS r FROM part")
def compute_dialect(spark, sf):
    return _expressions(load(spark, sf, "part"), ["p_partkey"], "compute", exact=("n",), n="if_then_else(contains(p_name, 'a') == true, len(p_name), 0)", r="sqrt(p_size)")


@query("op_F14_pushdown_dialect", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), 0) AS v, round(l_quantity * 2 + 1, 6) AS w FROM lineitem")
def pushdown_dialect(spark, sf):
    return _expressions(_li(spark, sf), K, "pushdown", exact=("v",), v="coalesce($l_discount, $l_tax)", w="$l_quantity * 2 + 1")


@query("op_F15_arithmetic_template", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - 10) / 3 + l_quantity, 6) AS v, NULL::DOUBLE AS z FROM lineitem")
def arithmetic_template(spark, sf):
    return _expressions(_li(spark, sf), K, "template", v="(l_extendedprice - 10) / 3 + l_quantity", z="l_quantity / (l_tax - l_tax)")


@query("op_F17_string_transforms", "SELECT p_partkey, trim(' ' || p_name || ' ') AS t, p_name[2:4] AS sub, replace(p_brand, 'Brand', 'B') AS rep, regexp_extract(p_brand, '([0-9]+)', 1) AS num, strlen(p_name)::BIGINT AS bytes FROM part")
def string_transforms(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", scalars.trimmed(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("t"), F.substring("p_name", 2, 3).alias("sub"), F.replace("p_brand", F.lit("Brand"), F.lit("B")).alias("rep"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), F.octet_length("p_name").cast("long").alias("bytes"))


@query("op_F18_time_parts", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofweek(ts) AS wd, floor(epoch(ts))::BIGINT AS unix, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6, 3) AS age, strftime(ts, '%Y-%m-%d %H') AS f FROM events")
def time_parts(spark, sf):
    ts = F.col("ts")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return load(spark, sf, "events").select("event_id", *[f(ts).cast("long").alias(n) for n, f in (("y", F.year), ("mo", F.month), ("d", F.dayofmonth), ("h", F.hour), ("mi", F.minute), ("wd", scalars.weekday))], F.unix_seconds(ts).alias("unix"), F.round(scalars.age_seconds(ts, at), 3).alias("age"), scalars.formatted(ts, "2006-01-02 15").alias("f"))


@query("op_F20_templates", "SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS is_a, (l_returnflag = 'R')::INT AS is_r, (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS b, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS scaled, (dayofweek(l_shipdate) IN (0, 6)) AS weekend FROM lineitem")
def templates(spark, sf):
    """Scaling needs the table's bounds: one row, broadcast."""
    li = _li(spark, sf)
    bounds = F.broadcast(li.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")))
    hot = scalars.one_hot(F.col("l_returnflag"), ["A", "R"])
    return li.crossJoin(bounds).select(*K, hot["A"].alias("is_a"), hot["R"].alias("is_r"), scalars.bucket(F.col("l_quantity"), [10, 20, 40]).alias("b"), F.round((F.col("l_quantity") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"), scalars.weekday(F.col("l_shipdate")).isin(0, 6).alias("weekend"))


@query("op_F21_graph_nodes", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS s, round(l_quantity * l_tax, 6) AS m, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_quantity / l_tax, 6) END AS d FROM lineitem")
def graph_nodes(spark, sf):
    return _expressions(_li(spark, sf), K, "template", s="sum(l_quantity, l_tax)", m="l_quantity * l_tax", d="l_quantity / l_tax")


@query("op_F22_script_dialect", "SELECT event_id, round(sqrt(abs(value - 50)), 6) AS v, upper(event_type) AS k FROM events")
def script_dialect(spark, sf):
    return _expressions(load(spark, sf, "events"), ["event_id"], "script", v="sqrt(abs(value - 50))", k="upper(event_type)")


@query("op_F23_truthy", "SELECT event_id, (event_id % 2)::VARCHAR IN ('true', '1', 'yes') AS t FROM events")
def truthy(spark, sf):
    return load(spark, sf, "events").select("event_id", scalars.truthy(F.col("event_id") % 2).alias("t"))


@query("op_F24_coercion", "SELECT event_id, try_cast(event_type AS BIGINT) AS i, try_cast(user_id AS DOUBLE) AS f, user_id::VARCHAR AS s FROM events")
def coercion(spark, sf):
    return load(spark, sf, "events").select("event_id", scalars.coerced(F.col("event_type"), "INT64").alias("i"), scalars.coerced(F.col("user_id"), "float64").alias("f"), scalars.coerced(F.col("user_id"), "string").alias("s"))


@query("op_F25_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field(spark, sf):
    return load(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("op_F26_hash_bucket", "SELECT c_custkey, round(('0x' || substr(sha256(c_custkey::VARCHAR || 'exp1'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE, 9) AS share FROM customer")
def hash_bucket(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", F.round(scalars.hash_share(F.col("c_custkey"), "exp1"), 9).alias("share"))
