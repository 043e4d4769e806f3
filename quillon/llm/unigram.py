"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic
programming carries, for each end position, the best score and the number of
pieces on its path. Ties as in the tokenizers: a later candidate replaces the
best only if it scores strictly more, and candidates come by ascending start,
so the longest last piece wins. A character that no piece covers alone is
unknown: it costs the lowest score less 10, and counts its UTF-8 bytes (byte
fallback) or one for each run of such characters.

Texts are taken as they are, with spaces written as U+2581 and one put before
the first character. Where all scores are whole numbers, sums are exact, and
the best path of a text is the best paths of its runs up to the next U+2581 or
line feed, if no piece crosses there; runs are then counted once per worker
and cached. Otherwise the whole text is one run.

Defined results: a null or empty text has 0 tokens; an empty table gives an
empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED, CACHED_LENGTH = 800_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class UnigramCounter:
    def __init__(self, pieces: Iterable[tuple[str, float]], byte_fallback: bool = True):
        scores = dict(pieces)
        self.byte_fallback = byte_fallback
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        whole = all(s == int(s) and abs(s) < 2**31 for s in scores.values())
        crossing = any(regex.search(f"[^{SPACE}]{SPACE}|\n", p) for p in scores if p != "\n")
        self.runs = regex.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall if whole and not crossing and byte_fallback else None
        self.cache: dict[str, int] = {}

    def count_run(self, run: str) -> int:
        """Pieces on the best path of one run."""
        n = len(run)
        score, count, unknown = array("d", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1))), bytearray(n + 1)
        matches = self.matches.iter(run)
        at_end, match = next(matches, (n, None))
        for end in range(1, n + 1):
            here = []
            while match is not None and at_end == end - 1:
                here.append(match)
                at_end, match = next(matches, (n, None))
            here.sort(reverse=True)  # by ascending start
            best = None
            for length, s in here:
                total = score[end - length] + s
                if best is None or total > best:
                    best, count[end] = total, count[end - length] + 1
            if not here or here[-1][0] != 1:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best = total
                    more = len(run[end - 1].encode("utf-8")) if self.byte_fallback else int(not unknown[end - 1])
                    count[end], unknown[end] = count[end - 1] + more, 1
            score[end] = best
        return count[n]

    def cached(self, run: str) -> int:
        out = self.cache.get(run)
        if out is None:
            out = self.count_run(run)
            if len(run) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[run] = out
        return out

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.runs is None:
            return self.count_run(text)
        get, cached = self.cache.get, self.cached
        return sum([get(r) or cached(r) for r in self.runs(text)])


@lru_cache(maxsize=4)
def counter(path: str) -> UnigramCounter:
    """Counter for the ordinary pieces of a sentencepiece file; control, unknown and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return UnigramCounter(((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))), byte_fallback=True)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and n_tokens of each whole text."""

    def run(batches):
        of = counter(path or default_path())
        for batch in batches:
            n = [of.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long")
