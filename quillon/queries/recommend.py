"""Queries X14: recommendations of event types to users, and of parts by their descriptions and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as R
from ..registry import query
from ..tables import as_of, load

NOW = "2024-01-31 00:00:00"
#: A request's list: the five dearest parts.
CURRENT = "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5"

COLLABORATIVE = """m AS (SELECT user_id, event_type AS item, count(*) AS views,
    least(0.1 * count(*) + CASE WHEN max(value) > 150 THEN 0.5 ELSE 0 END + CASE WHEN sum(value) > 300 THEN 0.3 ELSE 0 END, 1.0)::DOUBLE AS strength FROM events WHERE value > 60 GROUP BY 1, 2),
a AS (SELECT user_id, count(*) AS n FROM m GROUP BY 1 HAVING sum(views) >= 5),
s AS (SELECT m.user_id, item, strength, n FROM m JOIN a USING (user_id)),
j AS (SELECT x.user_id AS u, y.user_id AS v, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS sim FROM s x JOIN s y ON x.item = y.item AND x.user_id <> y.user_id GROUP BY 1, 2),
col AS (SELECT u AS user_id, item, sum(sim * strength) / sum(sim) AS score FROM j JOIN s ON s.user_id = v WHERE sim >= 0.3 GROUP BY 1, 2)"""
POPULARITY = f"""pop AS (SELECT event_type AS item, least(0.3 * log10(count(*) + 1) / 6 + 0.4 * log10(count(*) FILTER (value > 60) + 1) / 4 + 0.03 * sum(CASE WHEN d < 30 THEN exp(-d / 30) ELSE 0 END), 1.0) AS score
FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6 AS d FROM events) GROUP BY 1)"""


def _collaborative(spark, sf):
    per = load(spark, sf, "events").filter("value > 60").groupBy(F.col("user_id").alias("user"), F.col("event_type").alias("item"))
    marks = per.agg(F.count("*").alias("views"), (F.max("value") > 150).alias("favourite"), (F.sum("value") > 300).alias("used"))
    return R.collaborative(marks.withColumn("strength", R.strength(F.col("views"), F.col("favourite"), F.col("used"))))


def _popularity(spark, sf):
    return R.popularity(load(spark, sf, "events"), "event_type", "ts", F.col("value") > 60, as_of(NOW))


def _current(spark, sf):
    return load(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)


@query("op_X14_collaborative", f"WITH {COLLABORATIVE} SELECT user_id, item, round(score, 6) AS score FROM col")
def collaborative(spark, sf):
    return _collaborative(spark, sf).select(F.col("user").alias("user_id"), "item", F.round("score", 6).alias("score"))


@query("op_X14_popularity", f"WITH {POPULARITY} SELECT item, round(score, 6) AS score FROM pop")
def popularity(spark, sf):
    return _popularity(spark, sf).select("item", F.round("score", 6).alias("score"))


@query(
    "op_X14_content",
    f"""WITH c AS ({CURRENT}), t AS (SELECT p.p_partkey, c.p_partkey AS k, p.p_brand = c.p_brand AS b, p.p_type = c.p_type AS t, p.p_size = c.p_size AS z,
  string_split(lower(p.p_name), ' ') AS x, string_split(lower(c.p_name), ' ') AS y FROM part p, c)
SELECT p_partkey, round(max(CASE WHEN p_partkey = k THEN 1.0 ELSE CASE WHEN b THEN 0.3 ELSE 0 END + CASE WHEN t THEN 0.3 ELSE 0 END + CASE WHEN z THEN 0.2 ELSE 0 END
  + 0.2::DOUBLE * len(list_filter(x, lambda w: list_contains(y, w))) / greatest(len(x), len(y)) END), 6)::DOUBLE AS score FROM t GROUP BY 1""",
)
def content(spark, sf):
    tagged = lambda df: df.withColumn("tags", F.split("p_name", " "))
    s = R.content(tagged(load(spark, sf, "part")), tagged(_current(spark, sf)), "p_partkey", {"p_brand": 0.3, "p_type": 0.3, "p_size": 0.2}, "tags")
    return s.select("p_partkey", F.round("score", 6).alias("score"))


@query(
    "op_X14_co_usage",
    f"""WITH c AS ({CURRENT}), u AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), w AS (SELECT DISTINCT l_orderkey FROM u WHERE l_partkey IN (SELECT p_partkey FROM c))
SELECT l_partkey, round(count(*)::DOUBLE / (SELECT count(*) FROM w), 6) AS score FROM u WHERE l_orderkey IN (SELECT l_orderkey FROM w) GROUP BY 1""",
)
def co_usage(spark, sf):
    current = _current(spark, sf).select(F.col("p_partkey").alias("l_partkey"))
    return R.co_usage(load(spark, sf, "lineitem"), current, "l_orderkey", "l_partkey").select("l_partkey", F.round("score", 6).alias("score"))


@query(
    "op_X14_ranked",
    f"""WITH {COLLABORATIVE}, {POPULARITY}
SELECT user_id, item, round(0.35 * col.score + 0.30 * 0.5 + 0.20 * pop.score + 0.15 * 0.5, 6) AS score FROM col JOIN pop USING (item)""",
)
def ranked(spark, sf):
    """Balanced scores without current items, whose content and context are neutral (0.5), nor a quality."""
    both = _collaborative(spark, sf).withColumnRenamed("score", "c").join(_popularity(spark, sf).withColumnRenamed("score", "p"), "item")
    score = R.final_score("balanced", F.col("c"), F.lit(0.5), F.col("p"), F.lit(0.5), F.lit(0.0))
    return both.select(F.col("user").alias("user_id"), "item", F.round(score, 6).alias("score"))
