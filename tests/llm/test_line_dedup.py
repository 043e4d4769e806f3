import random

from quillon.llm import line_dedup as L


def plain(rows, least):
    """Kept text of each row, by the definition: every run of lines with words against all earlier ones."""
    docs = sorted(((d is None, d, t.split("\n")) for d, t in dict.fromkeys(rows) if t is not None), key=lambda x: (x[0], x[1] or 0))
    words = lambda x: len(x.split())
    worded = [[i for i, x in enumerate(ls) if words(x)] for _, _, ls in docs]
    seen, out = set(), {}
    for (_, d, ls), at in zip(docs, worded):
        gone = set()
        for a in range(len(at)):
            runs, total = [], 0
            for b in range(a, len(at)):
                total += words(ls[at[b]])
                if total >= least:
                    key = tuple(ls[i] for i in at[a : b + 1])
                    runs.append(key)
                    if key in seen:
                        gone |= set(range(a, b + 1))
            seen.update(runs)
        own = {at[k] for k in gone}
        for i, x in enumerate(ls):
            if not words(x) and at:
                own |= {i} if (max((k for k in at if k < i), default=at[0])) in own else set()
        out[d, "\n".join(ls)] = ("\n".join(x for i, x in enumerate(ls) if i not in own), len(ls), len(own))
    return sorted(((d, *(out[(d, t)] if t is not None else (None, 0, 0))) for d, t in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{k}w{i}" for i in range(rng.choice([2, 5, 9, 20, 60]))) for k in range(12)] + ["", "  "]
    rows = []
    for i in range(60):
        ls = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(len(pool))
            ls += pool[a : a + rng.randint(1, 5)] if rng.random() < 0.7 else [f"own {i} {rng.random()} " * rng.randint(1, 30)]
        rows.append((i, "\n".join(ls)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1]), (None, rows[5][1]), (103, rows[7][1])]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as n_lines", "2 as _h", "3 as a", "4L as n_chars")
        got = sorted(map(tuple, L.line_dedup(docs, min_words=15).collect()), key=str)
        assert got == plain(rows, 15)
        kept = L.deduplicated(docs, min_words=15)
        assert kept.columns == docs.columns
        want = [(d, t) for d, t, n, gone in plain(rows, 15) if not (gone and gone == n)]
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in kept.collect())


def test_every_earlier_continuation(spark):
    """A run goes whole where it stands whole in an earlier document, though part of it stands in one before that."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, two, three = line("a", 30), line("b", 30), line("c", 10)
    rows = [(1, f"{one}\n{two}\nown 1"), (2, f"{one}\n{two}\n{three}\nown 2"), (3, f"{one}\n{two}\n{three}\nown 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in L.line_dedup(docs).collect()) == [(1, 0), (2, 2), (3, 3)]


def test_many_corpora(spark):
    """Hundreds of small corpora at once, each with lines of its own."""
    rng = random.Random(9)
    rows = []
    for c in range(300):
        for i in range(rng.randint(2, 6)):
            rows.append((len(rows), "\n".join(rng.choice(["", " ", *(" ".join([f"c{c}x{k}"] * n) for k, n in enumerate((1, 2, 3, 5, 8)))]) for _ in range(rng.randint(1, 14)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, L.line_dedup(docs, min_words=8).collect()), key=str)
    assert got == plain(rows, 8)
    assert sum(r[3] > 0 for r in got) > 300


def test_selection_thins_out(spark):
    """Only selected lines are joined: fewer than lines, far fewer than windows; without the selection each window would be one row."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "\n".join(f"{rng.random()} a b c d" for _ in range(200))) for i in range(20)], "doc_id long, text string")
    row = L.fingerprints(docs).selectExpr("count(*) n", "sum(size(_windows)) w").first()
    assert row.w > 20 * 180 and row.n < 20 * 200 / 2 and row.n < row.w / 4


def test_equal_lines_of_one_text(spark):
    """All lines of a text equal: the first stays."""
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "\n".join([line] * 100_000)), (2, "\n".join([line] * 3))], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in L.line_dedup(docs).collect()}
    assert got == {1: (100_000, 99_999), 2: (3, 0)}


def test_long_and_empty(spark):
    line = "word " * 40_000
    docs = spark.createDataFrame([(2, line + "\nx"), (1, "y\n" + line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in L.line_dedup(docs).collect()) == [(1, 0), (2, 1)]
    assert L.line_dedup(docs.limit(0)).count() == 0


def test_short_repeats_stay(spark):
    docs = spark.createDataFrame([(i, f"a frequent short line\nown {i}") for i in range(50)], "doc_id long, text string")
    assert {r.n_removed for r in L.line_dedup(docs).collect()} == {0}
