"""Recommendations, forecasts, clusters and percentiles against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import statistics as S
from quillon.operators import forecast as H
from quillon.operators import recommend as R


def test_collaborative_equals_pairs_of_users(spark):
    rng = random.Random(5)
    marks = [(u, f"i{i}", rng.randint(1, 6), round(rng.random(), 3)) for u in range(40) for i in range(9) if rng.random() < 0.4]
    marks += [(None, "i1", 9, 0.5), (7, None, 9, 0.5)]
    got = {(r.user, r.item): r.score for r in R.collaborative(spark.createDataFrame(marks, "user int, item string, views int, strength double")).collect()}
    per: dict = {}
    for u, i, v, s in marks[:-2]:
        per.setdefault(u, {})[i] = (v, s)
    per = {u: d for u, d in per.items() if sum(v for v, _ in d.values()) >= 5}
    want = {}
    for u in per:
        for i in {i for d in per.values() for i in d}:
            num = den = 0.0
            for v in per:
                sim = len(per[u].keys() & per[v].keys()) / len(per[u].keys() | per[v].keys())
                if v != u and sim >= 0.3 and i in per[v]:
                    num, den = num + sim * per[v][i][1], den + sim
            if den:
                want[u, i] = num / den
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_content_of_missing_columns_tags_and_list(spark):
    schema = "id int, c string, d string, tags array<string>"
    items = spark.createDataFrame([(1, "a", "x", ["P", "q"]), (2, "a", None, None), (3, "", "", []), (4, "b", "x", ["p"])], schema)
    score = lambda current: {r.id: round(r.score, 6) for r in R.content(items, current, "id", {"c": 0.4, "d": 0.4}, "tags").collect()}
    assert score(items.filter("id = 1")) == {1: 1.0, 2: 0.4, 3: 0.0, 4: 0.5}
    assert score(items.filter("id = 3"))[2] == 0.0
    assert set(score(items.filter("id > 9")).values()) == {0.5}


def test_hour_clusters_equal_plain_k_means(spark):
    rng = np.random.default_rng(3)
    rows = [(int(e), f"2024-01-{1 + int(rng.integers(28)):02d} {int(h):02d}:15:00") for e in range(30) for h in (rng.normal(6 * (e % 4) + 3, 1.5, 25) % 24)]
    got = {r.e: r.cluster for r in H.hour_clusters(spark.createDataFrame(rows, "e int, t string").withColumn("t", F.col("t").cast("timestamp")), "e", "t").collect()}
    x = np.zeros((30, 24))
    for e, t in rows:
        x[e, int(t[11:13])] += 1
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 12)
    c = x[:4].copy()
    for _ in range(20):
        at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[at == k].mean(axis=0) if (at == k).any() else np.zeros(24) for k in range(4)])
    assert got == dict(enumerate(at.tolist()))
    assert H.hour_clusters(spark.createDataFrame([], "e int, t timestamp"), "e", "t").count() == 0


def test_smoothed_rates_equal_the_fold(spark):
    rows = [(k, t) for k, times in {"a": [0, 10, 10, 40], "b": [5], "c": list(range(0, 4000, 3))}.items() for t in times]
    df = spark.createDataFrame([(k, n, t) for n, (k, t) in enumerate(rows)], "k string, n int, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.k: (r.rate, r.total) for r in H.smoothed_rates(df, ["k"], "ts", ["n"]).collect()}
    for k in "abc":
        times = [t for x, t in rows if x == k]
        rate = 1.0
        for a, b in zip(times, times[1:]):
            rate = 0.3 / (b - a) + 0.7 * rate if b > a else rate
        assert abs(got[k][0] - rate) < 1e-12 and got[k][1] == len(times)


def test_percentiles_of_heavy_tails_ties_and_nothing(spark):
    rng = np.random.default_rng(8)
    for values in (np.exp(rng.normal(0, 5, 3000)), np.repeat([1.0, 2.0], [900, 100]), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        row = S.quantiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).first()
        assert np.allclose(list(row), np.percentile(values, [50, 95, 0, 100]), rtol=1e-12)
    none = spark.createDataFrame([], "v double")
    assert S.snapshot(none, "v").first()["count"] == 0
    some = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    one = S.snapshot(some, "v").first()
    assert (one["skewness"], one["p99"], one["histogram"]) == (0.0, 3.0, [1.0] + [0.0] * 9)
    assert {r.test: r.passed for r in S.suite(some, some, "v").collect()} == dict.fromkeys(S.THRESHOLDS, True)
    assert all(r.statistic == 0.0 for r in S.suite(some, none, "v").collect())
