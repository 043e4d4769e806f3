import random
import re
from collections import Counter

from quillon.llm import mixing as M

WORD = re.compile(M.WORD)


def plain_targets(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] > 2 * size[s] + 1e-9}
        if not over:
            return {s: share.get(s, 2.0 * size[s]) for s in order}, size
        capped |= over


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"]) if i % 50 else "tiny"
        rows.append((rng.choice([i, i, 7, None]), rng.choice([" ", "\n", " \t "]).join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 300, 900]))) if rng.random() > 0.05 else None, source))
    return rows + rows[:5] + [(1, "", "empty only")]


def test_targets_and_taken(spark):
    rows = corpus(1, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as _src", "3 as taken", "4 as _h")
    want, size = plain_targets(rows)
    got = M.taken(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for t in M.checkpointed(M.targets(M.sizes(docs))).collect():
        assert abs(t.target - want[t["_source"]]) < 1e-6 * max(1, want[t["_source"]]) and t.source_size == size[t["_source"]]
        by[t["_source"]] = t.target
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    sums = Counter()
    for r in got:
        sums[(r.source_size, round(r.target, 6))] += r.taken
    goals = Counter()
    for s, t in by.items():
        goals[(size[s], round(t, 6))] += round(t)
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in goals.items() if v}
    assert sorted(map(str, got)) == sorted(map(str, M.taken(docs.repartition(5)).collect()))


def test_draw(spark):
    """Shards of a set size; counts spread as a multinomial's; numbered slots without a gap; the last shards correct to the needs."""
    needs = {1: 50_000, 2: 20_000, 3: 9_990, 4: 3, 5: 7}
    frame = spark.createDataFrame(list(needs.items()), "_src long, _n long")
    rows = [tuple(r) for r in M.drawn(frame, 500).collect()]
    assert sorted((s, k) for s, _, k in rows) == sorted((s, k) for s, n in needs.items() for k in range(n))
    drawn = Counter(), Counter()
    for s, shard, _ in rows:
        drawn[0][shard] += 1
        drawn[1][s, shard] += 1
    whole = [x for x in range(80) if drawn[0][x] == 500]
    assert len(whole) > 60 and max(drawn[0].values()) <= 500
    share = needs[1] / sum(needs.values())
    counts = [drawn[1][1, x] for x in whole]
    mean = sum(counts) / len(counts)
    spread = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert abs(mean - 500 * share) < 6 and 0.6 < spread / (500 * share * (1 - share)) < 1.6
    firsts = {s: sorted((shard, k) for x, shard, k in rows if x == s) for s in needs}
    assert all([k for _, k in f] == list(range(len(f))) for f in firsts.values())  # numbered shard after shard
    assert M.drawn(frame.limit(0)).count() == 0


def plain_taken(rows, n_blocks_rows, block):
    """Words of each document that a list of slots (source number, block, words) takes."""
    out = Counter()
    laid = {}
    for key, src, start, size in rows:
        laid.setdefault(src, []).append((start, start + size, key))
    for src, at, take in n_blocks_rows:
        for a, b, key in laid[src]:
            out[key] += max(0, min(b, at * block + take) - max(a, at * block))
    return out


def test_blocks_of_each_document(spark):
    """What each document gives, and in which shards, against the slots laid out by hand; other shards, other places."""
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(700, "a"), (30, "a"), (1, "a"), (256, "b"), (255, "b"), (40, "b"), (900, "c"), (5, None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized, goals = M.prepared(docs)
    some = M.pieces(sized, goals, len(rows), 64)
    places = {(r._id, r._src, r._start, r.size) for r in some.collect()}
    assert sorted(p[0] for p in places) == list(range(len(rows)))
    for src in {p[1] for p in places}:
        at = 0
        for _, _, start, size in sorted((p for p in places if p[1] == src), key=lambda p: p[2]):
            assert start == at
            at += size
    seen = {}
    for shard_slots in (8, 50):
        slots = M.slots(goals, 64, shard_slots).collect()
        want = plain_taken(places, [(r._src, r._block, r._take) for r in slots], 64)
        got = {r.doc_id: r for r in M.taken(docs, block=64, shard_slots=shard_slots).collect()}
        assert {d: r.taken for d, r in got.items()} == {d: want[d] for d in got}
        of_doc = {}
        for p in places:
            of_doc[p[0]] = sorted({r.shard for r in slots if r._src == p[1] and r._take and max(p[2], r._block * 64) < min(p[2] + p[3], r._block * 64 + r._take)})
        assert {d: r.shards for d, r in got.items()} == of_doc
        seen[shard_slots] = of_doc
        for src in {r._src for r in slots}:
            full = Counter(r._pass for r in slots if r._src == src)
            for p in range(max(full)):
                assert sorted(r._block for r in slots if r._src == src and r._pass == p) == list(range(full[p]))
    assert seen[8] != seen[50] and any(len(x) > 1 for x in seen[8].values())


def test_text_as_it_is(spark):
    """Runs of words are cut out of the text with what stands between them; all shards together hold the mix."""
    text = "\n\n".join(f"  a{i}\tb{i}  c{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text, "x", "en", len(text)), (2, "one two\n three", "x", "en", 14), (3, "w " * 3000, "y", "en", 6000)], "doc_id long, text string, source string, lang string, n_chars long")
    parts = [r for r in M.remixed(docs, block=50).collect() if r.doc_id == 1]
    assert parts
    assert all("\n\n" in r.text and "\t" in r.text for r in parts)
    one = Counter(w for r in M.remixed(docs, block=50).collect() for w in WORD.findall(r.text))
    by = M.remixed(docs, block=50, shard_slots=16, shard_col="lang")
    assert by.columns == ["lang", "doc_id", "text", "source", "n_chars"]
    by = by.collect()
    assert Counter(w for r in by for w in WORD.findall(r.text)) == one and len({r.lang for r in by}) > 3


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        from pyspark.sql import functions as F

        one = F.lit(1).cast("long")
        rows = spark.range(n).withColumn("y", M.permuted(F.col("id"), one, one, F.lit(n).cast("long"))).withColumn("z", M.permuted(F.col("y"), one, one, F.lit(n).cast("long"), inverse=True)).collect()
        assert sorted(r.y for r in rows) == list(range(n)) and all(r.id == r.z for r in rows)
        if n == 1000:
            assert sum(r.id == r.y for r in rows) < 10


def test_remixed(spark):
    rows = [(d, t, s, "en", len(t or "")) for d, t, s in corpus(4, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").selectExpr("*", "1 as _h", "2 as _nth")
    out = M.remixed(docs)
    assert out.columns == docs.columns
    got = out.collect()
    words = Counter()
    for r in got:
        assert r.n_chars == len(r.text)
        words[r.source] += len(WORD.findall(r.text))
    want, _ = plain_targets([r[:3] for r in rows])
    assert {s: n for s, n in words.items() if n} == {s: round(t) for s, t in want.items() if round(t)}
    whole = {(r[0], r[1]) for r in rows}
    assert sum((r.doc_id, r.text) in whole for r in got) > 30


def test_empty(spark):
    assert M.taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert {r.taken for r in M.taken(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()} == {0}
