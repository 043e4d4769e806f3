"""Parsers and plans of schedules, query language, sharding, admission and query lifecycles."""

from datetime import datetime

import pytest

from quillon.functions import cron
from quillon.operators import sharding
from quillon.plans import graphql
from quillon.sources import push
from quillon.streaming.pipelines import Queries


def test_cron():
    t = datetime(2024, 2, 28, 23, 59, 30)
    assert cron.parse("* * * * *").after(t) == datetime(2024, 2, 29)
    assert cron.parse("30 6 29 2 *").after(t) == datetime(2024, 2, 29, 6, 30)
    assert cron.parse("0 0 1 1 *").after(t) == datetime(2025, 1, 1)
    assert cron.parse("@weekly").after(t) == datetime(2024, 3, 3)
    assert cron.parse("5-10/2,50 */6 * * *").after(t) == datetime(2024, 2, 29, 0, 5)
    assert cron.parse("0 0 31 2 *").after(t) == t + cron.FAR
    assert cron.parse("@every 1h30m").after(datetime(1970, 1, 1, 1, 30)) == datetime(1970, 1, 1, 3)
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "a * * * *", "@every 5", "* * 0 * *"):
        with pytest.raises(ValueError):
            cron.parse(bad)


def test_graphql():
    (s,) = graphql.parse('query ($n: String = "x", $l: [Int!]) { a: feature(name: $n, entities: [1, "b"], deep: true) { ...f inner { z } } } fragment f on F { v: value }', {})
    assert (s.alias, s.name, s.arguments) == ("a", "feature", {"name": "x", "entities": [1, "b"], "deep": True})
    assert [(f.alias, f.name, [x.name for x in f.fields]) for f in s.fields] == [("v", "value", []), ("inner", "inner", ["z"])]
    for bad in ("{ a", "query ($n: String!) { a(n: $n) }", "{ ...no }", "mutation { a }", "{ a(b: $c) }", "{ a % }", ""):
        with pytest.raises(ValueError):
            graphql.parse(bad, {})


def test_ring(spark):
    from pyspark.sql import functions as F

    nodes = ["a", "b", "c", "d"]
    before = {r.id: r.o for r in spark.range(300).select("id", sharding.owners(F.col("id"), nodes, 2).alias("o")).collect()}
    after = {r.id: r.o for r in spark.range(300).select("id", sharding.owners(F.col("id"), [*nodes, "e"], 2).alias("o")).collect()}
    assert all(len(set(o)) == 2 for o in before.values()) and {o[0] for o in before.values()} == set(nodes)
    moved = [k for k in before if before[k][0] != after[k][0]]
    assert 0 < len(moved) < 150 and all(after[k][0] == "e" for k in moved)  # keys move to the new node only


def test_checked_and_admitted(spark):
    rows = [(1, "a", {"x": 1.0}), (2, None, {"x": 1.0}), (3, "b", None), (4, "b", {}), (5, "x" * 513, {"x": 1.0}), (6, "é" * 256, {"x": 1.0}), (7, "a", {"": 1.0})]
    got = {r.id: r.error for r in push.checked(spark.createDataFrame(rows, "id int, entity string, features map<string,double>")).collect()}
    assert got == {1: None, 2: "empty key", 3: "no features", 4: "no features", 5: "key above 512 bytes", 6: None, 7: "empty feature name"}
    sent = spark.sql("select id, 'c' as client, timestamp_micros(id * 300000) as ts from range(7)")
    assert [r.admitted for r in push.admitted(sent, "client", "ts", 2, "id").orderBy("id").collect()] == [True, True, False, False, True, True, False]


def test_lifecycle():
    class Fake:
        isActive = True

        def stop(self):
            self.isActive = False

        def exception(self):
            return None

    q = Queries()
    assert q.status("a") == "unknown"
    q.submit("a", Fake)
    with pytest.raises(ValueError):
        q.submit("a", Fake)
    q.run("a")
    assert q.status("a") == "running"
    q.pause("a")
    assert q.status("a") == "paused"
    q.run("a")
    q.stop("a")
    assert q.status("a") == "stopped"
    q.delete("a")
    assert q.status("a") == "deleted"
