"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding from vocabulary bytes.

A pre-token's symbols stand in a doubly linked list. Every adjacent pair with a
merge rank is queued by (rank, position); popped entries whose pair has changed
since are stale and skipped. Results of short pre-tokens are kept in a cache of
bounded size in each Python worker. Decoding joins the vocabulary's bytes.

Defined results: a null or empty text has no tokens and decodes to the empty
text; equal ids are encoded row by row; an empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "byte_bpe_50k.json"
#: The published pattern of this kind of tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED, CACHED_LENGTH = 600_000, 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in out)})
    return out


class BytePairCoder:
    """Vocabulary and merges of a tokenizer file; encodes and decodes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.rank = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda t: [t]
        self.words = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        first, rank = self.first, self.rank
        ids = [first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        queue = []
        get = rank.get
        for i in range(n - 1):
            m = get((ids[i], ids[i + 1]))
            if m is not None:
                queue.append((m[0], i, m[1]))
        if not queue:
            return ids
        heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            _, i, to = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = get((ids[i], ids[j]))
            if m is None or m[1] != to:  # stale: one of the two has been merged since
                continue
            ids[i] = to
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = get((to, ids[k]))
                if m is not None:
                    heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0:
                m = get((ids[h], to))
                if m is not None:
                    heappush(queue, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def packed(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        out = self.cache.get(word)
        if out is None:
            out = array("I", self.merged(word.encode("utf-8"))).tobytes()
            if len(word) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        get, packed = self.cache.get, self.packed
        for part in self.split(text) if self.special else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += [get(w) or packed(w) for w in self.words(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of such ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(path)


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids (array of int), n_tokens of each text."""

    def run(batches):
        bpe = coder(path or default_path())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [bpe.encode(t) for t in _texts(part.column(1))]
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                off = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), flat), pa.array(np.diff(off).astype(np.int64))], names=[id_col, "ids", "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and text of each row of ids; null ids give the empty text."""

    def run(batches):
        bpe = coder(path or default_path())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [bpe.decode(array("I", x.as_py() or []).tobytes()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    rows = encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded, in one pass."""

    def run(batches):
        bpe = coder(path or default_path())
        sha = hashlib.sha256
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [bpe.encode(t) for t in _texts(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                        pa.array([sha(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
