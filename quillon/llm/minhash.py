"""MinHash near-dedup with b-bit signatures.

1. Each text's set of word shingles gives BANDS * ROWS minima. Runs of ROWS
   minima are hashed to band keys; the low BITS of each (mixed) minimum are
   packed into a sketch. Texts with equal sets are one class.
2. Classes that share a band key are candidates; of buckets with the same members
   (by a 128-bit hash of them) one is compared. Their similarity is estimated
   by counting equal low bits and correcting for chance collisions; candidates
   that are ERRORS standard errors below the threshold are dropped. Components
   of the others are families.
3. In each family classes are compared on their full sets. Those at or above
   the threshold are linked; components of these links are the result.

Only components are wanted, so not all pairs of a large bucket or family need
comparing. Its members are cut into blocks of at most BLOCK classes (and BYTES
of sets), each block takes in the same few LEADERS as well, and pairs inside a
block are compared; tasks return stars, never pairs. What the leaders tie
together is one component already. Only members outside the largest component
are then compared with all others, chunk by block. So a large group costs tasks
of bounded size, about as many as its blocks, and is quadratic only in those of
its members that its leaders do not reach; no link between different texts is
left out.

What is lost: pairs at the threshold that share no band, (1 - s**ROWS)**BANDS of
them (5e-8 at 0.80), and pairs that the estimate drops, about 1e-9.

Defined results: letters A to Z are lower-cased; a null text, or one without
words, has no shingles and is linked with nothing; with fewer words than a
shingle's the whole sequence is one; null ids never are a component's name
unless it has no other; equal ids are kept alike; an empty table gives an empty
result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import SALTS, dealt, packed, stored, text_slices, unpacked
from .components import components

WORDS, PERCENT = 5, 80
BANDS, ROWS, BITS = 32, 4, 4
ERRORS = 6
BLOCK, BYTES, LEADERS = 512, 1 << 26, 16
_rng = np.random.default_rng(977)
MULTIPLY = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingles(data: np.ndarray, off: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    data = K.LOWER[data]
    starts, ends, of = K.words(data, off)
    h = K.span_hash(K.prefix(data), starts, ends)
    x = h
    for k in range(1, n_words):
        x = K.mix(x[: len(h) - k] * K.U(0xA0761D6478BD642F) + h[k:])
    bounds = np.searchsorted(of, np.arange(len(off)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n_words:
            s = np.sort(x[a : b - n_words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            whole = h[a : a + 1]
            for k in range(a + 1, b):
                whole = K.mix(whole * K.U(0xA0761D6478BD642F) + h[k : k + 1])
            out.append(K.mix(whole + K.U(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set; sets must not be empty."""
    x = (np.concatenate(sets) >> K.U(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    hashed = np.empty_like(x)
    for j, (a, b) in enumerate(zip(MULTIPLY, ADD)):
        np.multiply(x, a, out=hashed)
        hashed += b
        out[:, j] = np.minimum.reduceat(hashed, at)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band and row of minima; the band's number is part of it."""
    n = len(least)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * K.U(0x9E3779B97F4A7C15), (n, 1))
    parts = least.reshape(n, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = K.mix(key * K.U(0xA0761D6478BD642F) + parts[:, :, r])
    return key.view(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, 64 // BITS to a word; unused places are 0 in every row."""
    x = least ^ (least >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    low = (x & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    per = 64 // BITS
    out = np.zeros((len(least), -(-low.shape[1] // per)), np.uint64)
    for j in range(low.shape[1]):
        out[:, j // per] |= low[:, j] << K.U(BITS * (j % per))
    return out


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of every sketch of a to every one of b, corrected for chance collisions of BITS bits."""
    unit = K.U(sum(1 << BITS * k for k in range(64 // BITS)))
    unequal = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        x = a[:, word, None] ^ b[None, :, word]
        for shift in range(BITS - 1, 0, -1) if BITS & (BITS - 1) else [1 << k for k in range(BITS.bit_length() - 1)]:
            x |= x >> K.U(shift)
        unequal += np.bitwise_count(x & unit)
    chance = 1.0 / (1 << BITS)
    return (1 - unequal / (BANDS * ROWS) - chance) / (1 - chance)


def margin(similarity: float) -> float:
    """ERRORS standard errors of the estimate of a pair of that similarity."""
    chance = 1.0 / (1 << BITS)
    equal = similarity + (1 - similarity) * chance
    return ERRORS * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def stars(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row that it is connected to."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal values in the first columns, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(n_keys):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(n_keys)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _signed(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch.column(2)):
                sets = shingles(data, off, n_words)
                full = [i for i, s in enumerate(sets) if len(s)]
                node, keys, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    least = minima([sets[i] for i in full])
                    for i, k, s in zip(full, band_keys(least), sketches(least)):
                        node[i], keys[i], sketch[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), k, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["_id", "_h", "n_shingles", "node", "_keys", "_sketch"],
                )

    return run


def _star_rows(nodes: np.ndarray, linked: np.ndarray) -> tuple[list, list]:
    label = stars(linked)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved].tolist(), nodes[label[moved]].tolist()


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _cross(left: np.ndarray, chunk: int) -> np.ndarray:
    """Pairs that a task compares: all of a block, or those of a chunk of leftovers with a block's members."""
    return left[:, None] != left[None, :] if chunk >= 0 else np.ones((len(left), len(left)), bool)


def _candidates(least_similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for group in grouped(batches, 3):  # bucket, block, chunk, left, node, sketch
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            nodes = np.array(group.column(4).to_pylist(), object)
            s = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint64).reshape(len(nodes), -1)
            if len(nodes) == 2:
                if nodes[0] != nodes[1] and estimated(s[:1], s[1:])[0, 0] >= least_similarity:
                    out_a.append(nodes[0])
                    out_b.append(nodes[1])
            else:
                a, b = _star_rows(nodes, (estimated(s, s) >= least_similarity) & _cross(group.column(3).to_numpy(zero_copy_only=False), group.column(2)[0].as_py()))
                out_a += a
                out_b += b
            if len(out_a) > 20_000:
                yield _edges(out_a, out_b)
                out_a, out_b = [], []
        yield _edges(out_a, out_b)

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of all pairs of sets, as products of presence matrices over slices of their elements."""
    n = len(sets)
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    number, rows = (np.cumsum(shared) - 1)[number[keep]], rows[keep]
    out = np.zeros((n, n))
    step = 8192
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(number, (lo, lo + step))
        part = np.zeros((n, step), np.float32)
        part[rows[a:b], number[a:b] - lo] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def linked_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    sizes = np.array(list(map(len, sets)))
    common = intersections(sets)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):  # family, block, chunk, left, node, set
            if group.num_rows < 2:
                continue
            nodes = np.array(group.column(4).to_pylist(), object)
            sets = [np.frombuffer(x, np.uint64) for x in group.column(5).to_pylist()]
            cross = _cross(group.column(3).to_numpy(zero_copy_only=False), group.column(2)[0].as_py())
            yield _edges(*_star_rows(nodes, linked_sets(sets, percent) & cross))

    return run


def _tied(rows: DataFrame, key: str, payload: str, compare: Callable) -> DataFrame:
    """node and root for all nodes that compare() ties to others: rows (key, node, payload, _n and _parts of the key, its members and blocks)."""
    many = F.col("_parts") > 1
    block = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("_parts") - 1)
    leads = many & (F.pmod(F.xxhash64("node", F.lit("leads")), F.col("_n")) < LEADERS)
    schema = "a binary, b binary"

    def linked(some: DataFrame) -> DataFrame:
        some = some.select(key, "_block", "_chunk", "_left", "node", payload)
        # a set number of tasks: what they compute does not follow from the size of their rows
        spread = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return some.repartition(spread, key, "_block", "_chunk").sortWithinPartitions(key, "_block", "_chunk").mapInArrow(compare, schema)

    inside = rows.withColumn("_block", F.explode(F.when(leads, all_blocks).otherwise(F.array(block)))).withColumn("_chunk", F.lit(-1)).withColumn("_left", F.lit(False))
    known = components(linked(inside))
    # members of large groups outside the group's largest component meet all others
    large = rows.filter(many).join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = large.groupBy(key, "root", "_n").agg(F.count("*").alias("_m")).groupBy(key).agg(F.max(F.struct("_m", "root")).alias("_top"), F.first("_n").alias("_all"))
    left = sizes.select(key, F.col("_top.root").alias("_main"), F.ceil((F.col("_all") - F.col("_top._m")) / BLOCK).cast("int").alias("_chunks")).filter("_chunks > 0")
    left = stored(left)
    if left.isEmpty():
        return known
    large = dealt(large, left, [key], ["node"])
    members = large.withColumn("_block", block).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).withColumn("_left", F.lit(False))
    others = large.filter("root <> _main").withColumn("_block", F.explode(all_blocks)).withColumn("_chunk", F.pmod(F.xxhash64("node", F.lit("left")), F.col("_chunks")).cast("int")).withColumn("_left", F.lit(True))
    more = linked(members.unionByName(others))
    return components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS) -> DataFrame:
    """_id, _h (hash of the text), n_shingles, node (hash of the shingle set, null without any), _keys, _sketch."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_h"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return stored(rows.mapInArrow(_signed(n_words), f"_id {kind}, _h long, n_shingles long, node binary, _keys array<long>, _sketch binary"))


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: _id, _h, n_shingles, component_id."""
    sig = signed(docs, id_col, text_col, n_words)
    first = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_h").alias("h"))
    classes = stored(sig.filter("node is not null").groupBy("node").agg(F.min(first).alias("_first"), F.first("n_shingles").alias("n_shingles"), F.first("_keys").alias("_keys"), F.first("_sketch").alias("_sketch")))
    keyed = classes.select("node", F.explode("_keys").alias("_key"))
    buckets = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    # stored, as what follows reads them more than once
    shared = stored(dealt(keyed, buckets, ["_key"], ["node"]))
    # near copies fill many buckets with the same members: each such membership is compared once
    alike = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_x{k}") for k in range(2)]
    once = shared.groupBy("_key", "_n").agg(*alike).groupBy("_n", "_x0", "_x1").agg(F.min("_key").alias("_key")).select("_key")
    members = stored(dealt(shared, once, ["_key"], ["node"]).join(classes.select("node", "_sketch").hint("merge"), "node"))
    least = percent / 100 - margin(percent / 100)
    families = _tied(members.withColumn("_parts", F.ceil(F.col("_n") / BLOCK).cast("int")), "_key", "_sketch", _candidates(least))
    families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    members = families.join(classes.select("node", "n_shingles", F.col("_first.id").alias("_id"), F.col("_first.h").alias("_h")).hint("merge"), "node")
    sizes = members.groupBy("root").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_sum"))
    parts = F.ceil(F.greatest(F.col("_n") / BLOCK, F.col("_sum") * 8 / BYTES)).cast("int")
    chosen = stored(dealt(members, sizes.select("root", "_n", parts.alias("_parts")), ["root"], ["node"]).select("node", "root", "_n", "_parts", "_id", "_h"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch.column(4)):
                sets = pa.array([s.tobytes() for s in shingles(data, off, n_words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(4)), sets], names=["node", "family", "_n", "_parts", "_set"])

    texts = docs.select(F.col(id_col).alias("_tid"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_th"), F.col(text_col).cast("string").alias("_text"))
    # chosen grows with the corpus: never broadcast, so the plan is the same at every size
    wanted = texts.join(chosen.hint("merge"), F.col("_tid").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h"))).select("node", "root", "_n", "_parts", "_text")
    sets = wanted.mapInArrow(full_sets, "node binary, family binary, _n long, _parts int, _set binary")
    # read twice where a family is large: stored, so that texts are joined and cut into shingles once
    found = _tied(stored(sets), "family", "_set", _confirmed(percent))
    named = classes.select("node", F.col("_first.id").alias("_id")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = dealt(named, names, ["root"], ["node"]).select("node", "component_id")
    # copies of one set are a hot node: both sides are salted
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(2 * SALTS - 1))))
    rows = sig.select("_id", "_h", "n_shingles", "node").withColumn("_salt", F.pmod(F.xxhash64("_id", "_h"), F.lit(2 * SALTS)).cast("int"))
    return rows.join(salted.hint("merge"), ["node", "_salt"], "left").select("_id", "_h", "n_shingles", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links lead to), kept (whether that is its own)."""
    rows = clustered(docs, id_col, text_col, n_words, percent)
    return rows.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept, one of each component, in their own columns; texts without words stay."""
    gone = clustered(docs, n_words=n_words, percent=percent).filter(~F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("_id").alias("_gid"), F.col("_h").alias("_gh")).distinct()
    return unpacked(packed(docs).join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_h") == F.col("_gh")), "left_anti"), docs.columns)


#: The contract of op9 by exact comparison of all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
t(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, t.r FROM t JOIN e ON e.x = t.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(t.r) AS component_id, d.doc_id = min(t.r) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
