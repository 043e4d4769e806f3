import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import suffix_dedup as S


def plain(rows):
    first = {}
    for d, t in rows:
        raw, d = (t or "").encode(), S.LAST if d is None else d
        for i in range(len(raw) - S.LENGTH + 1):
            w = raw[i : i + S.LENGTH]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw, key = (t or "").encode(), S.LAST if d is None else d
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - S.LENGTH + 1):
            if first[raw[i : i + S.LENGTH]] < key:
                gone[i + 1 : i + 1 + S.LENGTH] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((d, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3))
def test_suffix_groups(seed, letters):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abc"[:letters]) for _ in range(rng.randint(50, 130))) for _ in range(3)]
    data = "".join(rng.choice(passages)[rng.randint(0, 30) :] + rng.choice("xyz\0") * rng.randint(0, 2) for _ in range(8)).encode() + b"q" * 50
    at = np.array(rng.sample(range(len(data) - 50), len(data) - 50))
    group = S.suffix_groups(np.frombuffer(data, np.uint8), at)
    words = [data[i : i + 50] for i in at.tolist()]
    ranks = {w: k for k, w in enumerate(sorted(set(words)))}
    assert group.tolist() == [ranks[w] for w in words]


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinrstß") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(8, 40)) for _ in range(5)] + ["ab " * 60, "x" * 140]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.6 else text(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (7, None), (8, ""), (9, passages[0]), (9, passages[1] + passages[0]), (9, passages[0]), (None, passages[2]), (None, passages[2] + "!"), (600, "short")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "'x' as key", "1 as doc", "2 as part")
        for hot in (S.HOT, 3, 0):
            got = sorted(map(tuple, S.suffix_dedup(docs, keep_text=False, hot_fragments=hot, hot_every=1).collect()), key=str)
            assert got == plain(rows)


def test_hot_passage_in_many_contexts(spark):
    """A string shorter than a window between ever other words, in every document: hot or not, sampled or not, the same result."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [(i, f"{word()} the very same forty bytes in every one of them {rng.choice('xyz') * 9}{word()}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for hot, every in ((10**9, 1), (50, 1), (50, 4)):
        if hot < 400:
            assert 0 < len(S.hot_keys(docs, hot, every)) < 100
        assert sorted(map(tuple, S.suffix_dedup(docs, keep_text=False, hot_fragments=hot, hot_every=every).collect()), key=str) == plain(rows)


def test_long_text(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abc \n") for _ in range(400_000))
    rows = [(1, long), (2, "z" * 60 + long[1000:300_000]), (3, "ab" * 150_000)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()}
    assert got == {1: (0, 0), 2: (299_000, 1), 3: (0, 0)}


def test_across_flushes(monkeypatch):
    rows = corpus(11)
    held = []
    for size in (50, 10**6):
        monkeypatch.setattr(S, "HELD", size)
        batches = lambda: iter([__import__("pyarrow").record_batch({"d": [d or 0 for d, _ in rows], "t": [0] * len(rows), "x": [t for _, t in rows]})])
        table = __import__("pyarrow").Table.from_batches(S._gather(batches())).sort_by("key")
        out = __import__("pyarrow").Table.from_batches(S._settle(iter(table.to_batches(max_chunksize=7)))).to_pylist()
        held.append({(r["doc"], r["packed"] >> 3) for r in out if r["packed"] & 3 == S.GOES})
    assert held[0] == held[1]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.suffix_dedup(docs).count() == 0
