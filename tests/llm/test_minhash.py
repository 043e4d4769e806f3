import random
import re

import numpy as np

from quillon.llm import minhash as M
from quillon.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def plain(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    name = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(sets[i]), name[find(i)], d == name[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 18))):
                ws[rng.randrange(len(ws))] = f"E{rng.randint(0, 99)}"
            rows.append((i, rng.choice([" ", "\n", "  "]).join(ws)))
            i += 1
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "One  TWO"), (905, "one"), (906, "É a b"), (907, "é a b"), (None, rows[0][1]), (5, rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, k, percent in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as _h", "3 as n_shingles")
        got = sorted(map(tuple, M.near_duplicates(docs, n_words=k, percent=percent).collect()), key=str)
        assert got == plain(rows, k, percent)
        kept = M.deduplicated(docs, k, percent)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, _, own in plain(rows, k, percent) if own)


def test_large_family(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randint(1, 4)):
            ws[rng.randrange(100)] = f"e{rng.randint(0, 999)}"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, M.near_duplicates(docs, n_words=3, percent=85).collect()), key=str) == plain(rows, 3, 85)


def test_large_family_in_pieces(spark, monkeypatch):
    """A large family of several components, whose members the leaders do not all reach; blocks also bounded by bytes."""
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "LEADERS", 2)
    monkeypatch.setattr(M, "BYTES", 1 << 14)
    rng = random.Random(4)
    rows, base = [], [f"w{i}" for i in range(60)]
    for i in range(120):  # a drifting text: each is like the one before, the ends are unlike
        if rng.random() < 0.8:
            base[rng.randrange(60)] = f"e{i}"
        if rng.random() < 0.1:
            for _ in range(8):
                base[rng.randrange(60)] = f"f{rng.randint(0, 9999)}"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, 3, 85)
    assert 3 < len({r[2] for r in want}) < 60
    assert sorted(map(tuple, M.near_duplicates(docs, n_words=3, percent=85).collect()), key=str) == want


def test_long_texts(spark):
    rng = random.Random(8)
    ws = [f"w{rng.randint(0, 10**6)}" for _ in range(150_000)]
    other = list(ws)
    for i in range(0, len(ws), 100):
        other[i] = "x"
    rows = [(2, " ".join(ws)), (1, " ".join(other)), (3, "w " * 100_000)]
    got = {r.doc_id: (r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}


def test_estimate():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            common = rng.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 2**63, 400 - len(common), dtype=np.uint64)]) for _ in range(2))
            true = len(common) / (800 - len(common))
            s = M.sketches(M.minima([a, b]))
            errors.append(M.estimated(s[:1], s[1:])[0, 0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(600, 700)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_drops_no_true_link():
    """Pairs of similarity exactly 0.80 that share a band all pass the estimate."""
    rng = np.random.default_rng(1)
    for _ in range(8):
        raw = [rng.integers(0, 2**64, 200, dtype=np.uint64) for _ in range(1000)]
        a, b = M.minima([r[:180] for r in raw]), M.minima([np.concatenate([r[:160], r[180:]]) for r in raw])
        shared = np.flatnonzero((M.band_keys(a) == M.band_keys(b)).any(axis=1))
        x, y = M.sketches(a), M.sketches(b)
        assert all(M.estimated(x[i : i + 1], y[i : i + 1])[0, 0] >= 0.8 - M.margin(0.8) for i in shared)
