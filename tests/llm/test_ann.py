import numpy as np
from pyspark.sql import functions as F

from quillon.llm import ann


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.2, 2, (3000, 1))
    x[50] = x[70]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as _v")
    got = ann.neighbours(frame, F.col("vec_id") % 20 == 0, block=700, queries=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(by) == 150
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        s = x @ x[q]
        for (_, v, score), after in zip(found, found[1:] + [None]):
            assert v != q and abs(score - s[v]) < 1e-9
            assert after is None or (-score, v) < (-after[2], after[1])
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {f[1] for f in found})
    assert hits / (20 * 150) >= 0.9


def recall(v, n_queries):
    """Share of the 20 nearest by brute force that a search with the fitted share finds; queries are not those it was fitted on."""
    n = len(v)
    index = ann.Index(np.arange(n), v)
    some = np.arange(1, n, max(1, n // ann.SAMPLE))
    share = index.fitted(some, v[some], 20)
    hits, asked = 0, range(0, n, max(1, n // n_queries))
    for q in asked:
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(index.search(q, v[q], 20, share)[0].tolist()))
    return hits / (20 * len(asked))


def test_recall_of_even_directions():
    """Random directions, where nearest vectors are hardly nearer than others, at several sizes and dimensions."""
    rng = np.random.default_rng(8)
    for n, dim in ((300, 64), (2000, 64), (9000, 64), (6000, 16), (4000, 256)):
        x = rng.standard_normal((n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert recall(x, 30) >= 0.9, (n, dim)


def test_recall_of_uneven_norms():
    """One very long vector, log-normal, even and Gaussian norms."""
    rng = np.random.default_rng(5)
    for dim in (16, 64, 256):
        x = rng.standard_normal((4000, dim))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        long = unit.copy()
        long[7] *= 10
        for name, v in (("one long", long), ("log-normal", unit * rng.lognormal(0, 1, (4000, 1))), ("0.2 to 2", unit * rng.uniform(0.2, 2, (4000, 1))), ("Gaussian", x), ("Gaussian, one long", x * np.where(np.arange(4000) == 7, 20, 1)[:, None])):
            assert recall(v, 40) >= 0.9, (name, dim)


def test_index_covers_structured_vectors_cheaply():
    """Clustered vectors: a small share of the rows is verified."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((200, 32))
    v = centres[rng.integers(0, 200, 8000)] + 0.1 * rng.standard_normal((8000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert recall(v, 40) >= 0.95
    index = ann.Index(np.arange(8000), v)
    assert np.mean([index.search(q, v[q], 20, ann.SHARES[0])[2] for q in range(0, 8000, 200)]) < 0.1 * 8000


def test_ties_of_copies(spark):
    """Copies at all places and in all blocks have one score and stand in order of id."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 64))
    for k, copies in enumerate((rng.choice(1200, 40, False), rng.choice(1200, 40, False), np.arange(100, 160))):
        x[copies] = x[copies[0]]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in ann.neighbours(frame, F.col("vec_id") % 10 == 0, block=300, queries=50).collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(by) == 120
    tied = 0
    for q, found in by.items():
        found.sort()
        scores = ann.products(x, x[q])
        assert [s for _, _, s in found] == [scores[v] for _, v, _ in found]
        order = [v for v in np.lexsort((np.arange(1200), -scores)).tolist() if v != q]
        groups = {s for _, _, s in found if (scores == s).sum() > 2}
        for s in groups:
            tied += 1
            here = [v for _, v, t in found if t == s]
            assert here == [v for v in order if scores[v] == s][: len(here)]
    assert tied >= 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.neighbours(frame, F.col("vec_id") % 20 == 0).collect() if r.query_id == 0)
    assert got == [(0, 1, 20, 1.0), (0, 2, 20, 1.0), (0, 3, 10, 0.5)]
    assert ann.neighbours(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
