"""Language identification by a blended-spectrum string kernel.

A text's features are the presence of its lower-cased character n-grams for n
from 1 to 3, hashed into FEATURES places; the kernel of two texts is the number
of places they share over the root of the product of their numbers. Nystroem
landmarks, some of each language's training texts, carry a kernel ridge
regression for each language against the rest. Scoring is one product of a
batch's presence matrix with the landmarks' and one with the weights.

The model is fitted on at most PER_LANGUAGE labelled texts of each language,
those of least hash of their id; everything else runs over all rows and whole
texts. The model's size depends on the number of languages only.

Defined results: null texts and texts without a letter are ``und`` with score
0; if no row is fit for training, all are; rows with null or equal ids are
predicted like any other; an empty table gives an empty result. Columns other
than those named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = 1 << 14
GRAMS = (1, 2, 3)
PER_LANGUAGE = 128
LANDMARKS = 32
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"


def present(text: str) -> np.ndarray:
    """Feature numbers of a text's n-grams, each once, in order."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = np.zeros(FEATURES, bool)
    h = np.zeros(len(c), np.uint64)
    for n in GRAMS:
        h = (h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out[(h >> np.uint64(20)) & np.uint64(FEATURES - 1)] = True
    return np.flatnonzero(out)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) or any(unicodedata.category(c)[0] == "L" for c in text if ord(c) > 127)


def presence(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set, scaled so that products of rows are kernel values."""
    out = np.zeros((len(sets), FEATURES), np.float32)
    for row, s in zip(out, sets):
        row[s] = 1.0 / np.sqrt(max(len(s), 1))
    return out


class Model:
    """Landmarks and weights; languages in order."""

    def __init__(self, languages: list[str], landmarks: list[np.ndarray], weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights
        self._matrix: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_matrix": None}

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values of each text for each language."""
        if self._matrix is None:
            self._matrix = np.ascontiguousarray(presence(self.landmarks).T)
        return (presence(sets) @ self._matrix).astype(np.float64) @ self.weights


def fit(rows: list[tuple[str, np.ndarray]]) -> Model | None:
    """Model of (language, features) pairs in a fixed order; None without any."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    landmarks = [s for lang in languages for s in [s for k, s in rows if k == lang][:LANDMARKS]]
    z, x = presence(landmarks).astype(np.float64), presence([s for _, s in rows]).astype(np.float64)
    k_nm, k_mm = x @ z.T, z @ z.T
    y = np.array([[1.0 if lang == k else -1.0 for k in languages] for lang, _ in rows])
    left = k_nm.T @ k_nm + RIDGE * len(rows) * k_mm + 1e-8 * len(rows) * np.eye(len(landmarks))
    return Model(languages, landmarks, np.linalg.solve(left, k_nm.T @ y))


def training_rows(docs: DataFrame, may_train: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, np.ndarray]]:
    """Language and features of at most PER_LANGUAGE rows of each language, in order of a hash of their ids."""
    rows = docs.filter(may_train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.xxhash64(text_col).alias("_t"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return []
    # of a large language only the rows of least hash are ranked, some 8 times as many as are taken
    place = F.pmod(F.xxhash64("_h", "_t"), F.lit(1 << 31)) / float(1 << 31)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, 8.0 * PER_LANGUAGE / n)])
    rows = rows.withColumn("_u", place).filter(F.col("_u") < F.try_element_at(share, F.col("_lang")))
    ranked = F.row_number().over(Window.partitionBy("_lang").orderBy("_u", "_h", "_t"))
    chosen = rows.withColumn("_n", ranked).filter(F.col("_n") <= PER_LANGUAGE)
    keys = [(r["_h"], r["_t"], r["_lang"], r["_n"]) for r in chosen.collect()]  # PER_LANGUAGE for each language
    spark = docs.sparkSession
    keyed = F.broadcast(spark.createDataFrame(keys, "_h long, _t long, _l string, _n int").dropDuplicates(["_h", "_t", "_l"]))
    texts = docs.filter(may_train).select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.xxhash64(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_l"), F.col(text_col).cast("string").alias("_text")).join(keyed, ["_h", "_t", "_l"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [present(t.as_py()).astype(np.int32) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int32()))], names=["_l", "_n", "_set"])

    got = texts.select("_l", "_n", "_text").mapInArrow(features, "_l string, _n int, _set array<int>").dropDuplicates(["_l", "_n"]).collect()
    return [(r["_l"], np.array(r["_set"], np.int64)) for r in sorted(got, key=lambda r: (r["_l"], r["_n"]))]


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that training never sees; a null id is in no fold and not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of each document; learns from rows that are not held out."""
    model = fit(training_rows(docs, ~held_out(id_col), id_col, text_col, lang_col))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = [t.as_py() or "" for t in part.column(2)]
                known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    values = model.scores([present(texts[i]) for i in known])
                    odds = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
                    best = odds.argmax(axis=1)
                    for i, k, p in zip(known, best, odds.max(axis=1) / odds.sum(axis=1)):
                        lang[i], score[i] = model.languages[k], float(p)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string"))
    return rows.mapInArrow(predict, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
