"""Line dedup by winnowing over line hashes.

Lines without words take no part. A run of lines with at least MIN_WORDS words
is deleted where it equals a run that starts earlier, in its own or another
document. Every line of such a run is in one of two sorts of windows inside it:
the shortest run of MIN_WORDS words that starts at a line, or the shortest that
ends at one. So no pair of documents has to be walked along:

1. Winnowing: each window selects its least line hash, the last of equal ones.
   Equal windows select the same line, so two documents that share a run are
   guaranteed to share a fingerprint. All windows that select one line are one
   row: the fingerprint, and the lines around it that they reach over (its
   surroundings).
2. Positions are joined on the fingerprint alone: those whose fingerprint stands
   once in the corpus are done with.
3. Of positions with equal surroundings all but the earliest go, with all the
   lines that their windows reach over.
4. The earliest ones of different surroundings of one fingerprint are matched on
   both sides of it: each of their windows, which differ in how far they reach
   left and right, meets the earliest equal one of the same fingerprint, and the
   lines of the later one go. Neighbouring fingerprints carry the match on along
   the run, whichever document each stretch of it stood in before.

No step forms pairs: a position meets one row, the earliest, and a frequent
fingerprint is spread over its surroundings and over SALTS tasks each.

Earlier means the smaller (doc_id, line); null ids come last. Lines are equal
if their bytes are (judged by 64-bit hashes, windows by two). Runs of fewer than
MIN_WORDS words are left alone, as is every first occurrence. A line without
words goes with the line with words before it, or the first one of the text.

Defined results: a null text stays null and has no lines; an empty text has one
line without words; rows equal in id and text are one document and get equal
results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import dealt, packed, stored, text_slices, unpacked

MIN_WORDS = 50
PLACE = ["_id", "_h", "p"]


def windows(n_words: np.ndarray, of: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the shortest runs of min_words words that start or end at each line; lines have words and are numbered by text in of."""
    sums = np.concatenate([[0], np.cumsum(n_words)])
    first, last = np.searchsorted(of, of, "left"), np.searchsorted(of, of, "right")
    at = np.arange(len(n_words))
    ends = np.searchsorted(sums, sums[:-1] + min_words, "left")
    begins = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    right, left = ends <= last, begins >= first
    a, b = np.concatenate([at[right], begins[left]]), np.concatenate([ends[right], at[left] + 1])
    both = np.unique(a * (len(at) + 1) + b)
    return both // (len(at) + 1), both % (len(at) + 1)


def selected(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The line that each window selects: the last one of its least hash."""
    n = len(hashes)
    order = np.lexsort((-np.arange(n), hashes))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.arange(n), n
    return order[np.minimum.reduceat(rank, np.stack([starts, ends], 1).ravel())[::2]]


def _fingerprints(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_slices(batch.column(2)):
            starts, ends, of = K.lines(data, off)
            first, _, _ = K.words(data, off)
            n_words = np.searchsorted(first, ends) - np.searchsorted(first, starts)
            some = n_words > 0
            total = np.bincount(of, minlength=hi - lo)
            number = (np.arange(len(of)) - np.searchsorted(of, of))[some]
            hashes, n_words, of = K.span_hash(K.prefix(data), starts[some], ends[some]), n_words[some], of[some]
            a, b = windows(n_words, of, min_words)
            if not len(a):
                continue
            mark = selected(hashes, a, b)
            order = np.lexsort((b, a, mark))
            a, b, mark = a[order], b[order], mark[order]
            at = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            p, left, right = mark[at], np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(K.mix(hashes) * K.powers(len(hashes))[0][: len(hashes)], out=sums[1:])
            around = K.mix(K.span_hash(sums, left, right) + (p - left).astype(np.uint64) * K.U(0xC2B2AE3D27D4EB4F))
            text = of[p]
            zero = np.searchsorted(of, text)
            # in the text's own lines, each line with words together with those without that follow it
            same = of[1:] == of[:-1]
            begin = np.where(np.concatenate([[False], same]), number, 0)
            end = np.where(np.append(same, False), np.append(number[1:], 0), total[of])
            int32 = lambda x: pa.array(x.astype(np.int32))
            w = pa.StructArray.from_arrays([int32(begin[a]), int32(end[b - 1]), pa.array(K.span_hash(sums, a, b).view(np.int64))], names=["a", "b", "w"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(text)),
                    batch.column(1).slice(lo, hi - lo).take(pa.array(text)),
                    pa.array(hashes[p].view(np.int64)),
                    pa.array(around.view(np.int64)),
                    int32(p - zero),
                    int32(begin[left]),
                    int32(end[right - 1]),
                    pa.ListArray.from_arrays(int32(np.append(at, len(a))), w),
                ],
                names=["_id", "_h", "mark", "around", "p", "a", "b", "_windows"],
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per selected line: _id, _h (hash of the text), mark (fingerprint), around (hash of its surroundings), p (its number among the lines with words), a and b (the lines that its windows reach over), _windows (a, b and hash of each)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_h"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _h long, mark long, around long, p int, a int, b int, _windows array<struct<a: int, b: int, w: long>>"
    return rows.filter(F.col("_text").isNotNull()).mapInArrow(lambda it: _fingerprints(it, min_words), schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of lines as the maximal runs that they make up."""
    for batch in batches:
        out = []
        for spans in batch.column(2):
            spans = spans.values
            a, b = (spans.field(k).to_numpy().astype(np.int64) for k in range(2))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate([[True], a[1:] > b[:-1]])
            out.append([{"a": x, "b": y} for x, y in zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:], len(a)) - 1].tolist())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["_id", "_h", "_runs"])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _h (hash of the text), _runs (in order, the ranges a to b of lines that go) of the documents that have any."""
    place: Column = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_h").alias("h"), F.col("p").alias("p"))
    rows = stored(fingerprints(docs, id_col, text_col, min_words))
    marks = rows.groupBy("mark").agg(F.count("*").alias("_n"), (F.min("around") < F.max("around")).alias("_several")).filter("_n > 1").drop("_n")
    repeated = dealt(rows, marks, ["mark"], PLACE)
    first = repeated.groupBy("mark", "around").agg(F.min(place).alias("_first"))
    judged = dealt(repeated, first, ["mark", "around"], PLACE).withColumn("_later", place > F.col("_first")).filter("_later or _several")
    judged = stored(judged.select("_id", "_h", "mark", "p", "a", "b", F.when(~F.col("_later"), F.col("_windows")).alias("_windows")))
    open_ = judged.filter("_windows is not null").select("_id", "_h", "mark", "p", F.inline("_windows"))
    firsts = open_.groupBy("mark", "w").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    matched = dealt(open_, firsts, ["mark", "w"], PLACE).filter(place > F.col("_first"))
    spans = judged.filter("_windows is null").select("_id", "_h", "a", "b").unionByName(matched.select("_id", "_h", "a", "b"))
    of_text = spans.groupBy("_id", "_h").agg(F.collect_set(F.struct("a", "b")).alias("_runs"))
    return of_text.mapInArrow(_merged, f"_id {rows.schema['_id'].dataType.simpleString()}, _h long, _runs array<struct<a: int, b: int>>")


def _kept(text: Column) -> Column:
    """The lines of text outside its _runs."""
    lines = F.split(text, "\n", -1)
    begins, ends = F.concat(F.array(F.lit(0)), F.col("_runs.b")), F.concat(F.col("_runs.a"), F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(begins.alias("s"), ends.alias("e")), lambda x: F.slice(lines, x["s"] + 1, x["e"] - x["s"])))


def _joined(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows (_id, _h and others) with the _runs of their text."""
    runs = runs.withColumnsRenamed({"_id": "_rid", "_h": "_rh"})
    return rows.join(runs, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_h") == F.col("_rh")), "left").drop("_rid", "_rh")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, text without the repeated lines, n_lines, n_removed."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_h"), F.col(text_col).cast("string").alias("_text"))
    rows = _joined(rows, repeated_runs(docs, id_col, text_col, min_words))
    text = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.concat_ws("\n", _kept(F.col("_text"))))
    n_lines = F.coalesce(F.regexp_count("_text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    gone = F.coalesce(F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"]), F.lit(0).cast("long"))
    return rows.select(F.col("_id").alias(id_col), text.alias("text"), n_lines.alias("n_lines"), gone.alias("n_removed"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs in their own columns, with repeated lines gone from text; documents that lose every line go."""
    rows = _joined(packed(docs), repeated_runs(docs, min_words=min_words))
    whole = F.col("_row").getField("text")
    rows = rows.withColumn("_kept", F.when(F.col("_runs").isNotNull(), _kept(whole))).filter(F.col("_kept").isNull() | (F.size("_kept") > 0))
    text = F.when(F.col("_kept").isNull(), whole).otherwise(F.concat_ws("\n", "_kept"))
    return unpacked(rows, docs.columns, text=text, n_chars=F.length(text).cast("long"))


#: All windows of all texts compared; on tables whose ids are distinct and not null.
SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
al AS (SELECT doc_id, len(ls) AS n, ls, unnest(range(1, len(ls) + 1)) AS i FROM t),
wl AS (SELECT doc_id, n, i, ls[i] AS s, len(regexp_extract_all(ls[i], '[^ 	-
]+')) AS k FROM al),
l AS (SELECT doc_id, n, i, s, k, row_number() OVER w AS p, sum(k) OVER w AS upto,
        CASE WHEN row_number() OVER w = 1 THEN 1 ELSE i END AS a, lead(i, 1, n + 1) OVER w AS b FROM wl WHERE k > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, list(s ORDER BY p) AS ss, list(upto ORDER BY p) AS us, list(a ORDER BY p) AS aa, list(b ORDER BY p) AS bb FROM l GROUP BY doc_id),
w AS (
  SELECT DISTINCT doc_id, f, e FROM (
    SELECT l.doc_id, p AS f, len(list_filter(us, lambda u: u < upto - k + 50)) + 1 AS e, len(us) AS m FROM l JOIN d ON d.doc_id = l.doc_id
    UNION ALL
    SELECT l.doc_id, len(list_filter(us, lambda u: u <= upto - 50)) + 1 AS f, p AS e, len(us) FROM l JOIN d ON d.doc_id = l.doc_id WHERE upto >= 50
  ) WHERE e <= m
),
x AS (SELECT w.doc_id, f, e, hash(array_to_string(ss[f:e], chr(10))) AS h1, md5(array_to_string(ss[f:e], chr(10))) AS h2, aa[f] AS a, bb[e] AS b FROM w JOIN d ON d.doc_id = w.doc_id),
y AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, f) AS nth FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM y WHERE nth > 1),
r AS (SELECT al.doc_id, count(g.i) AS removed, string_agg(ls[al.i], chr(10) ORDER BY al.i) FILTER (WHERE g.i IS NULL) AS kept FROM al LEFT JOIN g ON g.doc_id = al.doc_id AND g.i = al.i GROUP BY al.doc_id)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(len(string_split(o.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(removed, 0)::BIGINT AS n_removed
FROM documents o LEFT JOIN r ON r.doc_id = o.doc_id
"""
