"""Contract columns of every query, and equality with SQL where there is some, on the smallest tables."""

import os

import duckdb
import pytest

from quillon.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_collision_ann": ["query_id", "rank", "vec_id", "score"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken", "shards"],
    "op6_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_quality_hosts": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    kinds = dict(df.dtypes)
    assert all(kinds[c] == ("int" if c == "rank" else "array<bigint>" if c == "shards" else "double" if c in ("score", "target") else "boolean" if c in ("held_out", "base_failed", "kept") else "string" if c.endswith("256") or c == "lang_pred" else "bigint") for c in df.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(cur.fetchall()) == sorted(tuple(r[c] for c in names) for r in df.collect())
