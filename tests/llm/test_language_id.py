import random
import zlib

import numpy as np

from quillon.llm import language_id as L

TEXTS = {"en": "the and of that with from this which have there their about would", "de": "der die und das nicht ein eine mit für ist auch wird über können", "fr": "le la les des est une dans pour que avec été nous être où"}


def corpus(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TEXTS))
        rows.append((i, " ".join(rng.choice(TEXTS[lang].split()) for _ in range(rng.randint(8, 60))), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "en"), (1002, "12 ?! ☃", None), (1003, "the and of that", None), (None, "der die und das nicht", None), (5, "le la les des", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as _text")
    got = L.language_id(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[2]}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    out = [r for r in got if r.held_out and r.doc_id < 1000]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id != 5}
    assert (by[1000], by[1001], by[1002], by[1003], by[None]) == ("und", "und", "und", "en", "de")


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "the and", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in L.language_id(docs).collect()] == [("und", 0.0)]
    assert L.language_id(docs.limit(0)).count() == 0


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(120)
    other = [(d, t, ("xx" if zlib.crc32(str(d).encode()) % 4 == 2 else lang)) for d, t, lang in rows]
    a, b = (sorted(map(tuple, L.language_id(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect())) for r in (rows, other))
    assert a == b


def test_kernel_value():
    a, b = L.present("abab"), L.present("abc")
    k = (L.presence([a]) @ L.presence([b]).T)[0, 0]
    assert abs(k - len(set(a) & set(b)) / np.sqrt(len(a) * len(b))) < 1e-6
