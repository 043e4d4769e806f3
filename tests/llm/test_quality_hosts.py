import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from quillon.llm import quality_hosts as Q
from quillon.llm.common import text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    ws = WORD.findall(text or "")
    wins = Counter(zip(ws, ws[1:], ws[2:]))
    at = {i + k for i in range(len(ws) - 2) if wins[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(at))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#\n\t 🙂", max_size=60)), max_size=12), st.integers(1, 80))
def test_counts(texts, size):
    got = []
    for _, _, data, off in text_slices(pa.array(texts, pa.string()), size):
        got += list(zip(*(c.tolist() for c in Q.counts(data, off))))
    assert got == [plain(t) for t in texts]


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(30)] + [(100 + i, good, "bad") for i in range(3)]
    rows += [(200 + i, good, f"h{i % 5}") for i in range(100)] + [(300, None, None), (301, good, None), (301, good, None), (None, good, "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as kept", "'x' as _host", "2 as n_words")
    got = {(r.doc_id, r.base_failed, r.kept) for r in Q.quality_hosts(docs).collect()}
    assert (0, True, False) in got and (100, False, False) in got and (200, False, True) in got
    assert (300, True, False) in got and (301, False, True) in got and (None, False, True) in got
    kept = Q.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d in [*range(200, 300), 301, 301, None])
    assert Q.quality_hosts(docs.limit(0)).count() == 0 and Q.keep_documents(docs.limit(0)).count() == 0


def test_long_text():
    text = "lorem ipsum dolor " * 200_000
    (_, _, data, off), = text_slices(pa.array([text]))
    assert [int(c[0]) for c in Q.counts(data, off)][0] == 600_000
    assert np.diff(off).sum() == len(text)
