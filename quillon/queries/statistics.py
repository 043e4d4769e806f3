"""Queries M: drift, anomalies, quality, experiments, privacy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import statistics as S
from ..operators import forecast
from ..registry import query
from ..tables import features, load

CUT = "2024-01-16 00:00:00"


def halves(spark, sf, field="value"):
    e = load(spark, sf, "events")
    return e.filter(f"ts < timestamp'{CUT}'").select(field), e.filter(f"ts >= timestamp'{CUT}'").select(field)


def rounded(df, digits=6, exact=()):
    """df with doubles rounded as SQL rounds them; those named in exact are left as they are."""
    return df.select(*[scalars.rounded(F.col(c), digits).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


KS = f"""SELECT max(abs(ca / na - cb / nb)) AS ks FROM (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
FROM (SELECT value AS v, count(*) FILTER (ts < TIMESTAMP '{CUT}') AS a, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS b FROM events GROUP BY 1) WINDOW w AS (ORDER BY v))"""
BINS = f"""WITH g AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / (hi - lo) * {{0}}), {{0}} - 1) AS bin, count(*) FILTER (ts < TIMESTAMP '{CUT}') AS r, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS c FROM events, g GROUP BY 1),
t AS (SELECT bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM (SELECT unnest(range(0, {{0}})) AS bin) LEFT JOIN c USING (bin))"""
CATS = f"""WITH t AS (SELECT event_type, count(*) FILTER (ts < TIMESTAMP '{CUT}') AS r, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS c FROM events GROUP BY 1), u AS (SELECT *, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM t)"""


@query("op_M01_ks", f"SELECT round(ks, 6) AS ks FROM ({KS})")
def ks(spark, sf):
    return rounded(S.ks(*halves(spark, sf), "value"))


@query("op_M03_psi", BINS.format(10) + "SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM (SELECT coalesce(r, 0) / nr + 1e-4 AS e, coalesce(c, 0) / nc + 1e-4 AS a FROM t)")
def psi(spark, sf):
    return rounded(S.psi(*halves(spark, sf), "value"))


@query("op_M04_psi_smoothed", BINS.format(20) + "SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM (SELECT (r + 0.5) / (nr + 10) AS e, (c + 0.5) / (nc + 10) AS a FROM t)")
def psi_smoothed(spark, sf):
    return rounded(S.psi_smoothed(*halves(spark, sf), "value"))


@query("op_M05_psi_categorical", CATS + "SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM (SELECT (r + 1e-4) / nr AS e, (c + 1e-4) / nc AS a FROM u)")
def psi_categorical(spark, sf):
    return rounded(S.psi_categorical(*halves(spark, sf, "event_type"), "event_type"))


DIV = BINS.format(10) + ", s AS (SELECT greatest(r / nr, 1e-10) AS p, greatest(c / nc, 1e-10) AS q FROM t)"


@query("op_M06_jensen_shannon", DIV + "SELECT round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 6) AS js FROM s")
def jensen_shannon(spark, sf):
    return rounded(S.divergences(*halves(spark, sf), "value").select("js"))


@query("op_M30_kullback_leibler", DIV + "SELECT round(sum(p * ln(p / q)), 6) AS kl FROM s")
def kullback_leibler(spark, sf):
    return rounded(S.divergences(*halves(spark, sf), "value").select("kl"))


@query("op_M07_drift_decision", f"""WITH k AS ({KS}), r AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE ts < TIMESTAMP '{CUT}'), c AS (SELECT avg(value) AS m FROM events WHERE ts >= TIMESTAMP '{CUT}')
SELECT round(ks, 6) AS ks, round(abs(c.m - r.m) / r.s, 6) AS mean_shift, CASE WHEN ks > 0.1 THEN 'distribution' WHEN abs(c.m - r.m) / r.s > 3 THEN 'mean' ELSE 'none' END AS verdict FROM k, r, c""")
def drift_decision(spark, sf):
    return rounded(S.drift(*halves(spark, sf), "value"))


@query("op_M08_skew_status", "SELECT event_type, CASE WHEN d > 5 THEN 'skewed' WHEN d > 3.5 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT event_type, abs(avg(value) FILTER (event_id % 2 = 0) - avg(value) FILTER (event_id % 2 = 1)) AS d FROM events GROUP BY 1)")
def skew_status(spark, sf):
    d = F.abs(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) - F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))))
    out = load(spark, sf, "events").groupBy("event_type").agg(d.alias("d"))
    return out.select("event_type", F.when(F.col("d") > 5, "skewed").when(F.col("d") > 0.7 * 5, "warning").otherwise("healthy").alias("status"))


@query("op_M09_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def percentile(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", F.lit(0.95)), 4).alias("p95"))


@query("op_M10_nearest_rank", "SELECT user_id, v[least(floor(len(v) * 0.95)::BIGINT + 1, len(v))] AS p95 FROM (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1)")
def nearest_rank(spark, sf):
    return S.nearest_rank(load(spark, sf, "events"), ["user_id"], "value", 0.95).withColumnRenamed("value", "p95")


@query("op_M11_rolling_anomaly", """SELECT event_id, CASE WHEN n < 10 THEN 'learning' WHEN s > 0 AND abs(value - m) > 3 * s THEN 'zscore' WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 'iqr' ELSE 'normal' END AS anomaly
FROM (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""")
def rolling_anomaly(spark, sf):
    return S.rolling_anomalies(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 30, 10).select("event_id", "anomaly")


@query("op_M12_isolation_forest")
def isolation_forest(spark, sf):
    return S.isolation_scores(load(spark, sf, "events"), "value", "event_id").select("event_id", F.round("score", 6).alias("score"))


@query("op_M13_correlation_shift", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS whole, round(corr(l_quantity, l_extendedprice) FILTER (l_shipdate >= TIMESTAMP '1997-01-01'), 6) AS recent FROM lineitem")
def correlation_shift(spark, sf):
    recent = F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")
    return load(spark, sf, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("whole"), F.round(F.corr(F.when(recent, F.col("l_quantity")), F.when(recent, F.col("l_extendedprice"))), 6).alias("recent"))


@query("op_M14_co_occurrence", """WITH a AS (SELECT event_type AS k, ts, event_id FROM events WHERE value > 100), n AS (SELECT k, count(*) AS n FROM a GROUP BY 1)
SELECT x.k AS k1, y.k AS k2, count(*) AS pairs, round(count(*) / greatest(max(n1.n), max(n2.n)), 6) AS rate FROM a x JOIN a y ON x.k < y.k AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 600000000 JOIN n n1 ON n1.k = x.k JOIN n n2 ON n2.k = y.k GROUP BY 1, 2""")
def co_occurrence(spark, sf):
    from ..operators import joins

    a = load(spark, sf, "events").filter("value > 100").select(F.col("event_type").alias("k"), "ts", F.lit(1).alias("all"))
    n = a.groupBy("k").agg(F.count("*").alias("n"))
    pairs = joins.within(a, a, "all", 600).filter("left_k < right_k").groupBy(F.col("left_k").alias("k1"), F.col("right_k").alias("k2")).agg(F.count("*").alias("pairs"))
    out = pairs.join(n.select(F.col("k").alias("k1"), F.col("n").alias("n1")), "k1").join(n.select(F.col("k").alias("k2"), F.col("n").alias("n2")), "k2")
    return out.select("k1", "k2", "pairs", F.round(F.col("pairs") / F.greatest("n1", "n2"), 6).alias("rate"))


@query("op_M15_profile", """SELECT n, missing, round(uniq / n, 6) AS uniqueness, round(mean, 4) AS mean, round(sd, 4) AS sd, round(m3 / sd ** 3, 4) AS skew, round(m4 / sd ** 4 - 3, 4) AS kurt, CASE WHEN abs(m3 / sd ** 3) < 0.5 THEN CASE WHEN m4 / sd ** 4 - 3 < -1 THEN 'uniform' ELSE 'symmetric' END WHEN m3 > 0 THEN 'right_skewed' ELSE 'left_skewed' END AS shape
FROM (SELECT count(*) AS n, count(*) - count(v) AS missing, count(DISTINCT v) AS uniq, avg(v) AS mean, stddev_pop(v) AS sd, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM (SELECT l_extendedprice AS v, avg(l_extendedprice) OVER () AS mu FROM lineitem))""")
def profile(spark, sf):
    return rounded(S.profile(load(spark, sf, "lineitem"), "l_extendedprice").withColumn("uniqueness", F.round("uniqueness", 6)).select("n", "missing", "uniqueness", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "skew", "kurt")], "shape"))


@query("op_M16_feature_generation", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS log_price, round((l_quantity - m) / s, 6) AS z_qty, round(l_quantity * l_discount, 6) AS qty_x_disc, round(l_extendedprice / l_quantity, 6) AS price_per_qty FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def feature_generation(spark, sf):
    li = load(spark, sf, "lineitem")
    stats = F.broadcast(li.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s")))
    return rounded(li.crossJoin(stats).select("l_orderkey", "l_linenumber", F.ln(1 + F.col("l_extendedprice")).alias("log_price"), ((F.col("l_quantity") - F.col("m")) / F.col("s")).alias("z_qty"), (F.col("l_quantity") * F.col("l_discount")).alias("qty_x_disc"), F.try_divide("l_extendedprice", "l_quantity").alias("price_per_qty")))


@query("op_M17_parity_metrics", "SELECT round(avg(abs(l_discount - l_tax)), 6) AS mae, round(sqrt(avg((l_discount - l_tax) ** 2)), 6) AS rmse, round(corr(l_discount, l_tax), 6) AS r FROM lineitem")
def parity_metrics(spark, sf):
    d = F.col("l_discount") - F.col("l_tax")
    return rounded(load(spark, sf, "lineitem").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr("l_discount", "l_tax").alias("r")))


@query("op_M18_pair_parity", "SELECT l_returnflag, round(avg(CASE WHEN round(abs(l_discount - l_tax), 6) <= 0.01 OR round(abs(l_discount - l_tax), 6) <= round(0.1 * greatest(abs(l_discount), abs(l_tax)), 6) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lineitem GROUP BY 1")
def pair_parity(spark, sf):
    d = F.round(F.abs(F.col("l_discount") - F.col("l_tax")), 6)
    ok = (d <= 0.01) | (d <= F.round(0.1 * F.greatest(F.abs("l_discount"), F.abs("l_tax")), 6))
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(ok.cast("double")), 6).alias("rate"))


@query("op_M19_quality_rules", "SELECT l_linestatus, round(avg(CASE WHEN l_quantity BETWEEN 1 AND 40 THEN 1.0 ELSE 0.0 END), 6) AS in_range, round(avg(CASE WHEN l_returnflag IN ('A', 'N') THEN 1.0 ELSE 0.0 END), 6) AS in_set, round(avg(CASE WHEN l_shipdate >= TIMESTAMP '1995-01-01' THEN 1.0 ELSE 0.0 END), 6) AS fresh FROM lineitem GROUP BY 1")
def quality_rules(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return load(spark, sf, "lineitem").groupBy("l_linestatus").agg(share(F.col("l_quantity").between(1, 40)).alias("in_range"), share(F.col("l_returnflag").isin("A", "N")).alias("in_set"), share(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).alias("fresh"))


@query("op_M20_quality_gate", "SELECT round(0.4 * count(value) / count(*) + 0.3 * count(DISTINCT value) / count(*) + 0.3 * (1 - (count(*) - count(value)) / count(*)), 6) AS score FROM events")
def quality_gate(spark, sf):
    n, full = F.count("*"), F.count("value")
    return load(spark, sf, "events").agg(F.round(0.4 * full / n + 0.3 * F.count_distinct("value") / n + 0.3 * (1 - (n - full) / n), 6).alias("score"))


@query("op_M21_quality_grade", "SELECT event_type, CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM (SELECT event_type, 0.5 * avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) + 0.5 * avg(CASE WHEN value < 90 THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY 1)")
def quality_grade(spark, sf):
    s = 0.5 * F.avg((F.col("value") > 10).cast("double")) + 0.5 * F.avg((F.col("value") < 90).cast("double"))
    out = load(spark, sf, "events").groupBy("event_type").agg(s.alias("s"))
    return out.select("event_type", F.when(F.col("s") >= 0.9, "A").when(F.col("s") >= 0.8, "B").when(F.col("s") >= 0.7, "C").when(F.col("s") >= 0.6, "D").otherwise("F").alias("grade"))


@query("op_M22_importance", "SELECT event_type, round(0.4 * n / max(n) OVER () + 0.45 * sd / max(sd) OVER (), 6) AS score FROM (SELECT event_type, count(*) AS n, stddev_pop(value) AS sd FROM events GROUP BY 1)")
def importance(spark, sf):
    w = Window.partitionBy()
    g = load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd"))
    return g.select("event_type", F.round(0.4 * F.col("n") / F.max("n").over(w) + 0.45 * F.col("sd") / F.max("sd").over(w), 6).alias("score"))


@query("op_M23_experiment", """WITH v AS (SELECT CASE WHEN ('0x' || substr(sha256(user_id::VARCHAR || 'exp1'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE < 0.5 THEN 'control' ELSE 'test' END AS variant, value FROM events),
g AS (SELECT variant, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM v GROUP BY 1)
SELECT a.variant, a.n, round(a.mean, 6) AS mean, round(a.sd, 6) AS sd, round(100 * (a.mean - c.mean) / c.mean, 6) AS lift, round((a.mean - c.mean) / sqrt(a.sd * a.sd / a.n + c.sd * c.sd / c.n), 6) AS z, round(a.mean - c.mean - 1.96 * sqrt(a.sd * a.sd / a.n + c.sd * c.sd / c.n), 6) AS lo, round(a.mean - c.mean + 1.96 * sqrt(a.sd * a.sd / a.n + c.sd * c.sd / c.n), 6) AS hi FROM g a, g c WHERE c.variant = 'control' AND a.variant <> 'control'""")
def experiment(spark, sf):
    e = load(spark, sf, "events").withColumn("variant", scalars.variant(F.col("user_id"), "exp1", [("control", 0.5), ("test", 0.5)]))
    return rounded(S.experiment(e, "variant", "value", "control"))


@query("op_M24_significance", """WITH v AS (SELECT CASE WHEN ('0x' || substr(sha256(user_id::VARCHAR || 'exp1'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE < 0.5 THEN 'control' ELSE 'test' END AS variant, value FROM events),
g AS (SELECT variant, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM v GROUP BY 1),
z AS (SELECT a.variant, abs((a.mean - c.mean) / sqrt(a.sd * a.sd / a.n + c.sd * c.sd / c.n)) / sqrt(2) AS z FROM g a, g c WHERE c.variant = 'control' AND a.variant <> 'control'),
t AS (SELECT variant, z, 1 / (1 + 0.3275911 * z) AS t FROM z)
SELECT variant, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z), 6) AS p_value FROM t""")
def significance(spark, sf):
    e = load(spark, sf, "events").withColumn("variant", scalars.variant(F.col("user_id"), "exp1", [("control", 0.5), ("test", 0.5)]))
    out = S.experiment(e, "variant", "value", "control")
    return out.select("variant", F.round(2 * (1 - S.normal_cdf(F.abs("z"))), 6).alias("p_value"))


@query("op_M25_privacy")
def privacy(spark, sf):
    e = load(spark, sf, "events")
    return S.private_count(e, 1.0, 7).select(F.col("n").alias("noisy")).withColumn("kind", F.lit("count")).unionByName(S.private_sum(e, "value", 0, 100, 1.0, 8).select(F.col("s").alias("noisy")).withColumn("kind", F.lit("sum")))


@query("op_M25_budget", "SELECT event_id, round(sum(0.25) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9)::DOUBLE AS spent, spent <= 2 AS allowed FROM events")
def budget(spark, sf):
    """Queries that a budget of 2 for each user allows, a quarter for each."""
    e = load(spark, sf, "events").withColumn("epsilon", F.lit(0.25))
    return S.budgeted(e, "user_id", ["ts", "event_id"], "epsilon", 2.0).select("event_id", "spent", "allowed")


@query("op_M25_private_mean", "SELECT true AS mean_near, true AS gaussian_near, true AS greatest_near FROM events LIMIT 1")
def private_mean(spark, sf):
    """Noisy mean and greatest value at a large epsilon, against the true ones: within 1."""
    e = load(spark, sf, "events")
    true = e.agg(F.avg(F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0))).alias("m"), F.least(F.max("value"), F.lit(100.0)).alias("x"))
    a = S.private_mean(e, "value", 0.0, 100.0, 100.0, 3).withColumnRenamed("mean", "a")
    b = S.private_mean(e, "value", 0.0, 100.0, 100.0, 5, 1e-5).withColumnRenamed("mean", "b")
    x = S.private_extreme(e, "value", 0.0, 100.0, 2000.0, 7).withColumnRenamed("value", "v")
    near = lambda p, q: (F.abs(F.col(p) - F.col(q)) <= 1).cast("boolean")
    return true.crossJoin(a).crossJoin(b).crossJoin(x).select(near("m", "a").alias("mean_near"), near("m", "b").alias("gaussian_near"), near("x", "v").alias("greatest_near"))


@query("op_M26_freshness_ttl", "SELECT feature, round(60 + (1 - v) * (86400 - 60), 3) AS ttl FROM (SELECT event_type AS feature, least(0.4 * least(avg(CASE WHEN value <> p THEN 1.0 ELSE 0.0 END), 1) + 0.3 * least(avg(abs(value - p)) / 100, 1) + 0.3 * least(stddev_samp(value) / 50, 1), 1) AS v FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY 1)")
def freshness_ttl(spark, sf):
    p = F.lag("value").over(Window.partitionBy("entity", "feature").orderBy("ts", "version"))
    h = features(spark, sf).withColumn("p", p).filter("p is not null")
    capped = lambda c: F.least(c, F.lit(1.0))
    v = capped(0.4 * capped(F.avg((F.col("value") != F.col("p")).cast("double"))) + 0.3 * capped(F.avg(F.abs(F.col("value") - F.col("p"))) / 100) + 0.3 * capped(F.stddev_samp("value") / 50))
    return h.groupBy("feature").agg(F.round(60 + (1 - v) * (86400 - 60), 3).alias("ttl"))


@query("op_M27_impact", "SELECT event_type, round(least(100, 1.2 * (0.25 * least(100, 20 * log10(n)) + 0.2 * rel + 0.15 * users)), 6) AS impact FROM (SELECT event_type, count(*) AS n, 100 * avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS rel, least(100, count(DISTINCT user_id)) AS users FROM events GROUP BY 1)")
def impact(spark, sf):
    n, rel, users = F.count("*"), 100 * F.avg((F.col("value") > 0).cast("double")), F.least(F.lit(100), F.count_distinct("user_id"))
    s = 0.25 * F.least(F.lit(100.0), 20 * F.log10(n)) + 0.2 * rel + 0.15 * users
    return load(spark, sf, "events").groupBy("event_type").agg(F.round(F.least(F.lit(100.0), 1.2 * s), 6).alias("impact"))


@query("op_M32_chi_squared", CATS + "SELECT round(sum((c - x) ** 2 / x), 6) AS chi2 FROM (SELECT c, greatest(r * nc / nr, 1e-4) AS x FROM u)")
def chi_squared(spark, sf):
    return rounded(S.chi_squared(*halves(spark, sf, "event_type"), "event_type"))


@query("op_M33_ks_p_value", f"""WITH k AS ({KS}), n AS (SELECT count(*) FILTER (ts < TIMESTAMP '{CUT}')::DOUBLE AS n, count(*) FILTER (ts >= TIMESTAMP '{CUT}')::DOUBLE AS m FROM events), x AS (SELECT (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * ks AS x FROM k, n)
SELECT round(greatest(0, least(1, sum(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * x * x)))), 6) AS p FROM x, (SELECT unnest(range(1, 101)) AS i)""")
def ks_p(spark, sf):
    r, c = halves(spark, sf)
    n = r.agg(F.count("*").cast("double").alias("n")).crossJoin(c.agg(F.count("*").cast("double").alias("m")))
    return S.ks(r, c, "value").crossJoin(n).select(F.round(S.ks_p_value(F.col("ks"), F.col("n"), F.col("m")), 6).alias("p"))


@query(
    "op_M33_suite",
    BINS.format(10)
    + f""", k AS ({KS}), s AS (SELECT r / nr AS r, c / nc AS c FROM t),
u AS (SELECT greatest(c, 1e-4) AS a, greatest(r, 1e-4) AS e, c, greatest(c, 1e-10) AS p, greatest(r, 1e-10) AS q FROM s),
x AS (SELECT 'ks' AS test, ks AS v, 0.05::DOUBLE AS threshold FROM k
  UNION ALL SELECT 'psi', sum((a - e) * ln(a / e)), 0.2 FROM u
  UNION ALL SELECT 'chi_squared', sum((c - e) ** 2 / e), 0.05 FROM u
  UNION ALL SELECT 'jensen_shannon', sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0.1 FROM u)
SELECT test, round(v, 6) AS statistic, threshold, v <= threshold AS passed FROM x""",
)
def suite(spark, sf):
    return rounded(S.suite(*halves(spark, sf), "value"))


@query(
    "op_M33_snapshot",
    """WITH m AS (SELECT count(value) AS n, avg(value) AS m, var_pop(value) AS v, min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT avg((value - m) ** 3) AS m3, avg((value - m) ** 4) AS m4 FROM events, m),
h AS (SELECT list(coalesce(k, 0) / n ORDER BY i) AS histogram FROM (SELECT unnest(range(0, 10)) AS i)
  LEFT JOIN (SELECT least(floor((value - lo) / (hi - lo) * 10), 9) AS i, count(*) AS k FROM events, m GROUP BY 1) USING (i), m),
p AS (SELECT quantile_cont(value, [0.5, 0.9, 0.95, 0.99]) AS p FROM events)
SELECT n AS count, round(m, 6) AS mean, round(v, 4) AS variance, round(m3 / v ** 1.5, 6) AS skewness, round(m4 / v ** 2 - 3, 6) AS kurtosis, lo AS min, hi AS max,
  round(p[1], 6) AS p50, round(p[2], 6) AS p90, round(p[3], 6) AS p95, round(p[4], 6) AS p99, array_to_string(list_transform(histogram, lambda x: printf('%.6f', x)), ' ') AS histogram FROM m, c, h, p""",
)
def snapshot(spark, sf):
    s = S.snapshot(load(spark, sf, "events"), "value")
    # format_number rounds the binary value, as SQL's printf does; format_string rounds its shortest decimal, which differs at halves
    shares = F.array_join(F.transform("histogram", lambda x: F.format_number(x, 6)), " ")
    out = s.withColumn("variance", scalars.rounded(F.col("variance"), 4)).withColumn("histogram", shares)
    return rounded(out, exact=("variance", "min", "max"))


@query("op_M34_trend", "SELECT event_type, round(regr_slope(value, epoch(ts) / 86400 - 19723), 6) AS slope, round(regr_intercept(value, epoch(ts) / 86400 - 19723), 6) AS intercept FROM events GROUP BY 1")
def trend(spark, sf):
    day = F.unix_micros("ts") / 86400e6 - 19723
    return load(spark, sf, "events").groupBy("event_type").agg(F.round(F.regr_slope("value", day), 6).alias("slope"), F.round(F.regr_intercept("value", day), 6).alias("intercept"))


@query("op_M35_sigma_classes", "SELECT event_id, CASE WHEN abs(value - m) > 3 * s THEN 'critical' WHEN abs(value - m) > 2 * s THEN 'warning' ELSE 'normal' END AS class FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def sigma_classes(spark, sf):
    e = load(spark, sf, "events")
    stats = F.broadcast(e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")))
    d = F.abs(F.col("value") - F.col("m"))
    return e.crossJoin(stats).select("event_id", F.when(d > 3 * F.col("s"), "critical").when(d > 2 * F.col("s"), "warning").otherwise("normal").alias("class"))


@query("op_M36_smoothed_rate", """SELECT entity, round(list_reduce(list_prepend(1.0::DOUBLE, list(gap ORDER BY ts, event_id)), lambda a, g: 0.7 * a + 0.3 / g), 6) AS rate
FROM (SELECT user_id AS entity, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9 AS gap FROM events) WHERE gap > 0 GROUP BY 1""")
def smoothed_rate(spark, sf):
    """Exponentially smoothed events per hour of each entity, from 1.0."""
    return forecast.smoothed_rates(features(spark, sf), ["entity"], "ts", ["version"], unit=3600).filter("total > 1").select("entity", F.round("rate", 6).alias("rate"))


@query(
    "op_M36_forecast",
    """WITH g AS (SELECT user_id AS entity, event_type AS feature, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 3.6e9 AS gap FROM events),
r AS (SELECT entity, feature, list_reduce(list_prepend(1.0::DOUBLE, coalesce(list(gap ORDER BY ts, event_id) FILTER (gap > 0), [])), lambda a, g: 0.7 * a + 0.3 / g) AS rate, count(*) AS total,
  count(*) FILTER (hour(ts) = 12) AS hours FROM g GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT entity, feature, rate * hours / (total / 24.0::DOUBLE) AS adjusted, least(1.0::DOUBLE, total / 20.0::DOUBLE) AS sure FROM r)
SELECT entity, feature, round(adjusted, 3) AS predicted, round(sure, 3) AS confidence, round(adjusted * sure, 3) AS priority FROM f""",
)
def access_forecast(spark, sf):
    """Accesses per hour of each entity and feature, expected at noon."""
    return forecast.forecast(features(spark, sf), ["entity", "feature"], "ts", ["version"], hour=12, unit=3600)


@query("op_M36_hour_clusters")
def hour_clusters(spark, sf):
    return forecast.hour_clusters(features(spark, sf), "entity", "ts")


@query("op_M37_multi_party", "SELECT event_type, round(avg(v), 6) AS mean, count(*) AS parties FROM (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 10")
def multi_party(spark, sf):
    one = load(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return one.groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("parties")).filter("parties >= 10")


@query("op_M38_co_access", "SELECT a.event_type AS f1, b.event_type AS f2, count(*) AS users FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def co_access(spark, sf):
    d = load(spark, sf, "events").select("user_id", "event_type").distinct()
    a, b = d.withColumnRenamed("event_type", "f1"), d.withColumnRenamed("event_type", "f2")
    return a.join(b, "user_id").filter("f1 < f2").groupBy("f1", "f2").agg(F.count("*").alias("users"))


@query("op_M40_histogram", "SELECT least(floor((l_quantity - 1) / 49 * 7), 6)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    from ..operators import sets

    return sets.histogram(load(spark, sf, "lineitem"), "l_quantity", 7)


@query("op_M41_reducers", "SELECT event_type, round(sum(value * 2), 4) AS s, round(avg(value), 6) AS a, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE value > 5 GROUP BY 1")
def reducers(spark, sf):
    e = load(spark, sf, "events").filter("value > 5")
    return e.groupBy("event_type").agg(F.round(F.sum(F.col("value") * 2), 4).alias("s"), F.round(F.avg("value"), 6).alias("a"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
