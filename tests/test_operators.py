import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import quillon.queries  # noqa: F401
from quillon.functions import statistics, vectors
from quillon.operators import filters, graphs, joins, lookups, windows
from quillon.plans import composition, pipelines, streamsql
from quillon.registry import QUERIES

T0 = datetime(2024, 1, 1, 12)


def h(spark, rows):
    return spark.createDataFrame(rows, "entity string, value double, ts timestamp, version long")


def test_point_in_time(spark):
    rows = h(spark, [("u1", 0.5, T0 - timedelta(hours=3), 1), ("u1", 0.7, T0 - timedelta(hours=2), 2), ("u1", 0.9, T0 - timedelta(hours=1), 3), ("u2", 0.3, T0 - timedelta(hours=2), 4), ("u1", 0.8, T0 - timedelta(hours=2), 5)])
    spine = spark.createDataFrame([("u1", T0 - timedelta(hours=2), "a"), ("u2", T0 - timedelta(hours=1), "b"), ("u3", T0, "c")], "entity string, ts timestamp, label string")
    got = joins.point_in_time(spine, rows, ["entity"], ["value"], tie=["version"]).collect()
    assert sorted((r.entity, r.label, r.value) for r in got) == [("u1", "a", 0.8), ("u2", "b", 0.3)]
    left = joins.point_in_time(spine, rows, ["entity"], ["value"], how="left").collect()
    assert len(left) == 3 and [r.value for r in left if r.entity == "u3"] == [None]
    late = joins.point_in_time(spark.createDataFrame([("u1", T0)], "entity string, ts timestamp"), rows, ["entity"], ["value"], look_back_seconds=1800)
    assert late.count() == 0


def test_point_in_time_has_one_shuffle(spark):
    rows = h(spark, [("u1", 0.5, T0, 1)])
    df = joins.point_in_time(rows.select("entity", "ts"), rows, ["entity"], ["value"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_within(spark):
    a = spark.createDataFrame([("k", T0, 1), ("k", T0 + timedelta(seconds=100), 2), ("x", T0, 3)], "entity string, ts timestamp, n int")
    b = spark.createDataFrame([("k", T0 + timedelta(seconds=2), 7), ("k", T0 + timedelta(seconds=5), 8), ("y", T0, 9)], "entity string, ts timestamp, n int")
    pairs = lambda how, s: sorted(((r.left_n, r.right_n) for r in joins.within(a, b, "entity", s, how).collect()), key=str)
    assert pairs("inner", 5) == [(1, 7), (1, 8)]
    assert pairs("inner", 1) == []
    assert pairs("left", 2) == [(1, 7), (2, None), (3, None)]
    assert pairs("full", 2) == sorted([(1, 7), (2, None), (3, None), (None, 8), (None, 9)], key=str)


def test_put_and_resolve(spark):
    rows = h(spark, [("a", 1.0, T0, 1), ("a", 2.0, T0 + timedelta(1), 2), ("a", 3.0, T0 + timedelta(2), 2)]).withColumn("feature", F.lit("f"))
    assert [r.value for r in lookups.put(rows).collect()] == [2.0]
    s = h(spark, [("a", 1.0, T0, 5), ("b", 2.0, T0, 1)])
    t = h(spark, [("a", 9.0, T0, 4), ("c", 3.0, T0, 1)])
    got = lambda how: {r.entity: r.value for r in lookups.resolved(s, t, how).collect()}
    assert got("latest") == {"a": 9.0, "b": 2.0, "c": 3.0}
    assert got("higher_version")["a"] == 1.0 and got("source")["a"] == 1.0 and got("target")["a"] == 9.0


def test_windows(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t + timedelta(seconds=s), v, "k") for s, v in ((0, 10.0), (30, 20.0), (65, 30.0), (90, 40.0))], "ts timestamp, value double, k string")
    aggs = {"n": F.count("*"), "s": F.sum("value")}
    assert sorted((r.n, r.s) for r in windows.tumbling(df, "1 minute", ["k"], aggs).collect()) == [(2, 30.0), (2, 70.0)]
    df = spark.createDataFrame([(t + timedelta(seconds=s), float(i), "k") for i, s in enumerate((0, 10, 60, 70), 1)], "ts timestamp, value double, k string")
    assert sorted(r.s for r in windows.session(df, "30 seconds", ["k"], aggs).collect()) == [3.0, 7.0]
    v = spark.createDataFrame([(t, float(x)) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "ts timestamp, value double")
    assert v.agg(windows.aggregate("stddev", "value")).first()[0] == 2.0


def test_filters(spark):
    df = spark.createDataFrame([(5, "a"), (15, "b"), (20, "c"), (None, "d")], "col1 long, col2 string")
    assert [r.col2 for r in filters.scan(df, ["col2"], [("col1", "gt", 10)]).collect()] == ["b", "c"]
    assert filters.scan(df, ["col2"], [("col1", "strange", 1)]).count() == 0
    bad = df.select("col2", filters.violations({"col1": {"min": 10, "not_null": True}, "col2": {"regex": "^[abc]$"}}).alias("v")).collect()
    assert {r.col2: r.v for r in bad} == {"a": ["col1:min"], "b": [], "c": [], "d": ["col1:not_null", "col2:regex"]}
    routes = filters.route([("col2", "a", "x")], "rest")
    assert [r[0] for r in df.select(routes).collect()] == ["x", "rest", "rest", "rest"]


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as v", "id as w").write.parquet(str(tmp_path / "t"))
    df = filters.scan(spark.read.parquet(str(tmp_path / "t")), ["id"], [("v", "gt", 4)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,4)]" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan


def test_stream_sql(spark):
    t = {"s": spark.createDataFrame([("alice", 10.0, T0), ("bob", 20.0, T0), ("alice", 30.0, T0 + timedelta(minutes=2))], "user string, value double, ts timestamp")}
    run = lambda q: [tuple(r) for r in streamsql.execute(q, t).collect()]
    assert run("SELECT user, sum(value) AS v FROM s GROUP BY user ORDER BY v DESC LIMIT 1") == [("alice", 40.0)]
    assert run("SELECT user FROM s WHERE value > 15 AND user = 'alice' OR value = 20 ORDER BY value") == [("bob",), ("alice",)]
    assert len(run("SELECT count(*) AS n FROM s WINDOW TUMBLE(ts, '1m')")) == 2
    assert len(run("SELECT user, count(*) AS n FROM s GROUP BY user WINDOW SLIDE(ts, '5m', '1m')")) > 2
    assert run("SELECT user FROM s GROUP BY user ORDER BY user") == [("alice",), ("bob",)]
    for bad in ("SELECT 'x FROM s", "FROM s", "SELECT a FROM nope", "SELECT user FROM s LIMIT x", "SELECT user FROM s WINDOW NONE(ts)"):
        with pytest.raises(streamsql.StatementError):
            streamsql.execute(bad, t)
    assert "RANGE BETWEEN INTERVAL 1 hours PRECEDING" in streamsql.rewritten("SELECT sum(v) OVER (PARTITION BY k WINDOW '1h') FROM t")


def test_pipelines(spark):
    S = pipelines.Step
    steps = [S("sink", "sink", ["t"], {"columns": ["v"]}), S("t", "transform", ["s"], {"columns": {"v": "value * 2"}}), S("s", "source", [], {"table": "clicks"})]
    assert [s.name for s in pipelines.ordered(steps)] == ["s", "t", "sink"]
    out = pipelines.built(steps, {"clicks": spark.createDataFrame([(2.0,)], "value double")})
    assert out["sink"].first().v == 4.0
    with pytest.raises(ValueError, match="cycle"):
        pipelines.ordered([S("a", "filter", ["b"]), S("b", "filter", ["a"])])
    with pytest.raises(ValueError, match="no step"):
        pipelines.ordered([S("a", "filter", ["zz"])])


def test_composition_and_graphs(spark):
    assert graphs.levels({"c": ["a", "b"], "b": ["a"], "a": []}) == [["a"], ["b"], ["c"]]
    df = spark.createDataFrame([(2.0,)], "x double")
    assert composition.derived(df, "SOURCE x\nDERIVE z AS y + 1 FROM y\nDERIVE y AS x * 3 FROM x").first().z == 7.0
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = {(r.start, r.node): r.depth for r in graphs.reachable(e, spark.createDataFrame([("d",)], "node string")).collect()}
    assert got == {("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}


def test_similar_users_of_all(spark):
    """Every pair of users that share an item, those of equal sets and beyond any id too."""
    sets = {1: "ab", 5: "ab", 40: "bc", 900: "c", 901: "x", 902: "abx"}
    rows = spark.createDataFrame([(u, k) for u, kinds in sets.items() for k in kinds * 2], "user long, kind string")
    got = {(r.u, r.v): r.sim for r in vectors.similar_users(rows, "user", "kind").collect()}
    want = {(u, v): round(len(set(a) & set(b)) / len(set(a) | set(b)), 6) for u, a in sets.items() for v, b in sets.items() if u < v and set(a) & set(b)}
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_recommendation_reaches_all_users(spark):
    df = QUERIES["op_X14_recommendation"](spark, "/root/testdata/sf0.01")
    assert df.agg(F.max("v")).first()[0] >= 140


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_whole_tables_are_served(spark):
    """Users and customers beyond the ids of the short queries come out."""
    sf = "/root/testdata/sf0.01"
    most = lambda name: QUERIES[name](spark, sf).agg(F.max("entity")).first()[0]
    assert most("op_S04_streaming_lookup") == most("op_K07_point_in_time_export") == 149
    assert QUERIES["op_S19_batch_serving"](spark, sf).count() == 1500
    assert QUERIES["op_K14_exchange_count"](spark, sf).first()["n"] == 10_000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_inverted_lists_find_what_brute_force_finds(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vectors.InvertedLists(table)
    for metric in ("euclidean", "cosine", "dot"):
        for row in table.filter("vec_id % 150 = 0").collect():
            want = vectors.nearest(table, row.embedding, 10, metric).collect()
            assert index.search(row.embedding, 10, metric=metric).collect() == want


def test_inverted_lists_probe_what_they_must(spark):
    """Far lists are left out; a list with enough rows at an end does not hide a nearer one's."""
    rows = [(10 * k + i, [100.0 * k + i, 0.0]) for k in range(16) for i in range(10)]
    index = vectors.InvertedLists(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=160)
    for x in (0.0, 52.0, 155.0, 1509.0):
        want = sorted((round(abs(v[0] - x), 6), i) for i, v in rows)[:12]
        assert [(r.distance, r.vec_id) for r in index.search([x, 0.0], 12, probes=1).collect()] == want


def test_isolation_forest_of_common_values(spark):
    """Values that stand more often than the sample is large, and one outlier."""
    rows = spark.range(24_001).select("id", F.when(F.col("id") == 7, 10_000.0).otherwise((F.col("id") % 20).cast("double")).alias("value"))
    scores = {r.value: r.score for r in statistics.isolation_scores(rows, "value", "id").select("value", "score").distinct().collect()}
    assert len(set(scores.values())) > 5
    # the outlier is hardly in the sample: it scores as the end that it lies beyond
    assert scores[10_000.0] >= scores[19.0] > scores[10.0]


def test_reachable_goes_to_the_end(spark):
    """A chain of more than 50 steps."""
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(53)], "src string, dst string").coalesce(1)
    got = {r.node: r.depth for r in graphs.reachable(e, spark.createDataFrame([("n0",)], "node string").coalesce(1)).collect()}
    assert got == {f"n{i}": i for i in range(1, 54)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_centrality_ranks_all_tables(spark):
    kinds = {r.k for r in QUERIES["op_G04_centrality"](spark, "/root/testdata/sf0.001").select(F.substring("node", 1, 1).alias("k")).distinct().collect()}
    assert kinds == set("rncol")
