import hashlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quillon.llm import bpe  # noqa: E402

NASTY = ["", " ", "\n\n \t x", "a" * 3000, "ab" * 2000, "naïve café 漢字かな 🙂👍🏽 ​  x", "it's we'll I'D 12 345 ½ ²", "<|endoftext|>a<|endoftext|> b <|endoftext", "\x1c\x1d\x1e\x1f\x85\x0b\x0c", "  two  spaces   three    ", "é ﻿�"]


@pytest.fixture(scope="module")
def pair():
    return bpe.coder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


def test_equals_library(pair):
    own, lib = pair
    for text in NASTY:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text[:40]
        assert own.decode(own.encode(text)) == lib.decode(ids, skip_special_tokens=False)


def test_every_code_point(pair):
    own, lib = pair
    for lo in range(0, 0x110000, 512):
        text = "".join(f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000)
        if np.frombuffer(own.encode(text), "<u4").tolist() != lib.encode(text, add_special_tokens=False).ids:
            bad = [hex(c) for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000 and np.frombuffer(own.encode(f"a{chr(c)}{chr(c)} {chr(c)}1"), "<u4").tolist() != lib.encode(f"a{chr(c)}{chr(c)} {chr(c)}1", add_special_tokens=False).ids]
            assert not bad, bad


def test_decode_of_broken_bytes(pair):
    own, lib = pair
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 50257, 6)
        assert own.decode(ids.astype("<u4").tobytes()) == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_frames(spark, pair):
    own, lib = pair
    rows = [(1, None, "x"), (1, "hello world", "y"), (None, "", "z"), (3, "hello world", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.digests(docs).collect(), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = np.array(lib.encode("hello world", add_special_tokens=False).ids, "<u4").tobytes()
    assert sorted([(None, 0, sha(b""), sha(b"")), (1, 0, sha(b""), sha(b"")), (1, 2, sha(ids), sha(b"hello world")), (3, 2, sha(ids), sha(b"hello world"))], key=str) == sorted(map(tuple, got), key=str)
    back = bpe.decode(bpe.encode(docs).drop("n_tokens"))
    assert sorted(r.text for r in back.collect()) == ["", "", "hello world", "hello world"]
    assert bpe.digests(docs.limit(0)).count() == 0
