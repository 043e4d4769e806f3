"""Quality rules with host verdicts.

Base rules judge each document by counts over its whole text. Their failures
are added up by host (here the source), each host's rate is shrunk towards all
hosts' rates by a beta prior fitted to them by moments, and hosts whose shrunk
rate is too high are rejected with all their documents.

Defined results: a null text has no words, so it fails; a document without a
host (null) is judged by its own rules alone; equal ids are judged row by row;
an empty table gives an empty result. Columns other than id, text and host are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed, packed, text_slices, unpacked

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Prior observations for hosts whose rates do not differ, where moments give no strength.
EVEN_STRENGTH = 100.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of each text."""
    n = len(off) - 1
    starts, ends, of = K.words(data, off)
    sums = K.prefix(data)
    letters = ~K.SPACE[data] & ((data & 0xC0) != 0x80)
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        w = K.windows3(K.span_hash(sums, starts, ends))
        whole = of[:-2] == of[2:]
        key = w ^ K.mix(of[:-2].astype(np.uint64) + K.U(1))
        at = np.flatnonzero(whole)
        at = at[K.duplicated(key[whole])]
        for k in range(3):
            repeated[at + k] = True
    ls, le, lt = K.lines(data, off)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~K.SPACE[data], out=inside[1:])
    full = inside[le] > inside[ls]
    key = K.span_hash(sums, ls[full], le[full]) ^ K.mix(lt[full].astype(np.uint64) + K.U(1))
    texts = lt[full]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    return [
        np.bincount(of, minlength=n),
        K.per_text(letters, off),
        K.per_text(SYMBOLS[data], off),
        np.bincount(texts[again], minlength=n),
        np.bincount(of[repeated], minlength=n),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in counts(data, off))],
                names=["_id", "_host", *COUNTS],
            )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """_id, _host, the COUNTS and base_failed of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(host_col).alias("_host"))
    kind, host = rows.schema["_id"].dataType.simpleString(), rows.schema["_host"].dataType.simpleString()
    return rows.mapInArrow(_measure, f"_id {kind}, _host {host}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumn("base_failed", base_failed())


def host_rates(stats: DataFrame) -> DataFrame:
    """_host, n, failed and the shrunk rate of each host that is not null."""
    hosts = stats.filter(F.col("_host").isNotNull()).groupBy("_host").agg(F.count("*").alias("_n"), F.count_if("base_failed").alias("_f"))
    prior = hosts.agg((F.sum("_f") / F.sum("_n")).alias("_p"), F.var_pop(F.col("_f") / F.col("_n")).alias("_v"))
    p, v = F.col("_p"), F.col("_v")
    strength = F.when((v > 0) & (v < p * (1 - p)), F.try_divide(p * (1 - p), v) - 1).otherwise(F.lit(EVEN_STRENGTH))
    # one row is broadcast: the prior
    return hosts.crossJoin(F.broadcast(prior)).select("_host", "_n", "_f", ((F.col("_f") + p * strength) / (F.col("_n") + strength)).alias("_rate"))


def judged(stats: DataFrame, max_host_rate: float = MAX_HOST_RATE, salts: int = 16) -> DataFrame:
    """measured() rows with host_rate and kept.

    Verdicts are joined back on host and salt, so that the rows of a hot host
    are spread over that many tasks; the hosts' table is repeated as often.
    """
    verdicts = host_rates(stats).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = stats.withColumn("_salt", F.pmod(F.xxhash64("_id", *COUNTS), F.lit(salts)).cast("int"))
    out = rows.join(verdicts, ["_host", "_salt"], "left")
    return out.withColumn("host_rate", F.col("_rate")).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("_rate") > max_host_rate, F.lit(False)))


def quality_hosts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its id, the COUNTS, base_failed, host_rate, kept."""
    stats = checkpointed(measured(docs, id_col, text_col, host_col))
    return judged(stats, max_host_rate).select(F.col("_id").alias(id_col), *COUNTS, "base_failed", "host_rate", "kept")


def keep_documents(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs whose documents are kept, in their own columns.

    Verdicts come back by id and text hash, so that rows with equal ids and
    different texts are told apart.
    """
    rows = packed(docs).withColumn("_key", F.struct("_id", "_h", F.col("_row").getField("source").alias("_s")))
    marked = rows.select(F.col("_key").alias("key"), F.col("_row").getField("text").alias("text"), F.col("_row").getField("source").alias("source"))
    stats = checkpointed(measured(marked, "key"))
    rejected = judged(stats, max_host_rate).filter(~F.col("kept")).select(F.col("_id").alias("_bad")).distinct()
    return unpacked(rows.join(rejected, F.col("_key").eqNullSafe(F.col("_bad")), "left_anti"), docs.columns)


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win), (SELECT unnest(range(0, 3)) AS k)
  WHERE c > 1 GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN ln ON ln.doc_id = w.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS p, var_pop(k / n) AS v FROM h),
s AS (SELECT p, CASE WHEN v > 0 AND v < p * (1 - p) THEN p * (1 - p) / v - 1 ELSE 100.0 END AS z FROM m),
r AS (SELECT source, (k + p * z) / (n + z) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM f LEFT JOIN r ON r.source = f.source
"""
