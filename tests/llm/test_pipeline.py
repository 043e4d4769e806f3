import re
from collections import Counter

import pytest

from quillon.llm import bpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")
test_mixing = pytest.importorskip("tests.llm.test_mixing")
test_quality = pytest.importorskip("tests.llm.test_quality_hosts")
test_minhash = pytest.importorskip("tests.llm.test_minhash")
test_lines = pytest.importorskip("tests.llm.test_line_dedup")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows_of(docs)
    columns = docs.columns
    source = {r.doc_id: r.source for r in docs.collect()}

    out = corpus_pipeline.quality(spark, docs, SF)
    assert out.columns == columns
    counts = {d: test_quality.plain(t) for d, t in before}
    failed = {d: c[0] < 50 or 100 * c[4] > 50 * c[0] for d, c in counts.items()}
    # no host of these tables fails by itself, so the base rules decide
    now = rows_of(out)
    assert now == [(d, t) for d, t in before if not failed[d]]

    docs = spark.createDataFrame(out.collect(), out.schema)
    out = corpus_pipeline.lines(spark, docs, SF)
    assert out.columns == columns
    want = [(d, t) for d, t, n, gone in test_lines.plain(now, 50) if not (gone and gone == n)]
    now = rows_of(out)
    assert now == sorted(want, key=str) and all(r.n_chars == len(r.text) for r in out.collect())

    docs = spark.createDataFrame(out.collect(), out.schema)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == columns
    kept = {d for d, _, _, own in test_minhash.plain(now, 5, 80) if own}
    now = rows_of(out)
    assert {d for d, _ in now} == kept

    docs = spark.createDataFrame(out.collect(), out.schema)
    out = corpus_pipeline.mix(spark, docs, SF)
    assert out.columns == columns
    targets, _ = test_mixing.plain_targets([(d, t, source[d]) for d, t in now])
    words = Counter()
    for d, t in rows_of(out):
        words[source[d]] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert words.keys() == targets.keys() and all(abs(words[s] - t) <= 0.5 + 1e-6 for s, t in targets.items())

    last = corpus_pipeline.tokens(spark, out, SF)
    texts = sorted(rows_of(out))
    back = sorted((r.doc_id, r.text) for r in bpe.decode(last).collect())
    assert back == texts


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "n_tokens"] and got.count() > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
