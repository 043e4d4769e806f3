"""Approximate nearest neighbours by inner product, by collision-counting hashing.

Vectors are cut into blocks of about BLOCK, and each block into parts whose
norms differ by at most RATIO. In a part, every vector gets one more component
that makes all norms equal to the part's largest, so that the nearest by distance
are those of the largest inner product, and is projected on LINES random
directions; each direction keeps the values in a sorted array. Parts are searched
from the longest norms down, until no inner product with the next one's can reach
the best found. A query's window on each array starts around its own value and is
widened by virtual rehashing: each round multiplies the width, finds the window's
ends by bisection, and adds to the vectors' counts only what each window newly
takes in. Vectors that collide with the query on at least COLLISIONS of the
directions are candidates, verified by exact inner products; widening stops once
there are EXTRA times the neighbours asked for and a share of the part.

How large that share must be depends on the vectors: where nearest ones stand out
little will do, among even directions of many dimensions nearly all must be
verified. So it is fitted for each pair of blocks: SAMPLE of its queries are
searched exactly as well, and the least of SHARES that finds at least RECALL of
their neighbours is taken; the last of SHARES verifies all.

Equal vectors of a block are one entry with many ids, so copies neither crowd out
other candidates nor part from each other. The best candidates, with a margin for
rounding, are scored once more row by row, always summed in the same order: equal
vectors get equal scores wherever they stand.

Queries come in blocks as well, and each pair of blocks is one task; its best are
merged. Index and projections cover every row: nothing is sampled.

Defined results: rows whose vector is null, empty, zero or holds null or
non-finite components, or whose id is null, take no part; vectors are compared
with those of their own length; rows with the query's id are its own; a query
without candidates has no rows; an empty table gives an empty result. Columns
other than id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 20
BLOCK = 16384
QUERIES = 4096
LINES = 64
COLLISIONS = 0.80
FIRST_WIDTH, GROWTH = 1.1, 1.07
#: Candidates wanted: EXTRA times the neighbours asked for, and a share of the part, fitted on SAMPLE queries to reach RECALL.
EXTRA, SHARES, SAMPLE, RECALL = 5, (0.02, 0.05, 0.1, 0.2, 0.4, 1.0), 24, 0.97
#: Largest norm of a part over its smallest.
RATIO = 1.15
SEED = 11


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim) + 0.0  # no -0.0


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order."""
    return np.ascontiguousarray(vectors * query).sum(axis=1)


class Part:
    """Sorted projections of the vectors of a block that are about equally long."""

    def __init__(self, vectors: np.ndarray, squares: np.ndarray, lines: np.ndarray):
        self.vectors, self.lines = vectors, lines
        n = len(vectors)
        self.radius = float(np.sqrt(squares.max()))
        rest = np.sqrt(np.maximum(squares.max() - squares, 0))
        values = np.concatenate([self.vectors, rest[:, None]], axis=1) @ self.lines
        self.scale = float(values.std()) or 1.0
        order = values.argsort(axis=0, kind="stable")
        values = np.take_along_axis(values, order, axis=0)
        # all arrays in one, each beyond the reach of the one before, so that one bisection serves all
        self.step = 4 * (float(np.abs(values).max()) + self.radius) + 1.0
        self.base = np.arange(values.shape[1]) * self.step
        self.flat = np.ascontiguousarray((values + self.base).T).ravel()
        self.order = np.ascontiguousarray(order.T).ravel()
        self.first = np.arange(values.shape[1]) * n

    def _count(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each vector stands in some ranges of the arrays."""
        some = [self.order[a:b] for a, b in zip(begins.tolist(), ends.tolist()) if a < b]
        return np.bincount(np.concatenate(some), minlength=len(self.vectors)) if some else np.zeros(len(self.vectors), np.int64)

    def candidates(self, query: np.ndarray, wanted: int, threshold: int) -> np.ndarray:
        """Numbers of the vectors that collide on enough lines once at least wanted do."""
        n = len(self.vectors)
        if wanted >= n:
            return np.arange(n)  # the windows would be widened until they hold all
        # the query at the part's radius: its direction is all that counts
        at = (query / np.sqrt(query @ query) * self.radius) @ self.lines[:-1] + self.base
        reach = FIRST_WIDTH * self.scale
        lo = np.clip(self.flat.searchsorted(at - reach), self.first, self.first + n)
        hi = np.clip(self.flat.searchsorted(at + reach), self.first, self.first + n)
        # the first windows take in most of each array: what they leave out is counted
        counts = len(at) - self._count(np.concatenate([self.first, hi]), np.concatenate([lo, self.first + n]))
        while True:
            found = np.flatnonzero(counts >= threshold)
            if len(found) >= wanted or len(found) == n:
                return found
            reach = min(reach * GROWTH, self.step / 2)
            was_lo, was_hi = lo, hi
            lo = np.clip(self.flat.searchsorted(at - reach), self.first, lo)
            hi = np.clip(self.flat.searchsorted(at + reach), hi, self.first + n)
            counts += self._count(np.concatenate([lo, was_hi]), np.concatenate([was_lo, hi]))


class Index:
    """The parts of one block of vectors, the longest first; equal vectors are one entry."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES):
        dim = vectors.shape[1]
        rng = np.random.default_rng(SEED)
        # random orthonormal sets of directions, as many as give the wanted number of lines
        frames = [np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0] for _ in range(-(-lines // (dim + 1)))]
        directions = np.concatenate(frames, axis=1)[:, :lines]
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * dim))).ravel()
        _, first, entry = np.unique(raw, return_index=True, return_inverse=True)
        by_entry = np.lexsort((ids, entry))
        self.ids, self.bounds = ids[by_entry], np.searchsorted(entry[by_entry], np.arange(len(first) + 1))
        self.vectors = np.ascontiguousarray(vectors[first])
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        order = np.argsort(-squares, kind="stable")
        falling, self.parts, lo = -squares[order], [], 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(falling, falling[lo] / RATIO**2, "right")))
            some = order[lo:hi]
            self.parts.append((some, Part(self.vectors[some], squares[some], directions)))
            lo = hi

    def _top(self, query: np.ndarray, entries: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k + 1 best of some entries and their scores, and those that rounding may hold back; each has an id, and one of them may be the query's own."""
        if len(scores) > k + 1:
            cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            some = scores >= cut - 1e-9 * (abs(cut) + 1)
            return entries[some], scores[some]
        return entries, scores

    def _best(self, query_id: int, query: np.ndarray, entries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact inner products of the k best of some entries, nearest first, ties to the smaller id."""
        scores = products(self.vectors[entries], query)
        ids = [self.ids[self.bounds[e] : self.bounds[e + 1]] for e in entries.tolist()]
        ids = [i[i != query_id][:k] for i in ids]
        scores = np.repeat(scores, list(map(len, ids)))
        flat = np.concatenate(ids) if ids else np.empty(0, self.ids.dtype)
        best = np.lexsort((flat, -scores))[:k]
        return flat[best], scores[best]

    def search(self, query_id: int, query: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and inner products of the k best candidates, nearest first, ties to the smaller id, and the number of candidates."""
        length = float(np.sqrt(query @ query))
        entries, scores, seen = np.empty(0, np.int64), np.empty(0), 0
        for some, part in self.parts:
            # Cauchy-Schwarz, with room for rounding: neither this part nor a later one holds one that is better than k + 1 found
            if len(entries) > k and length * part.radius * (1 + 1e-9) < scores.min():
                break
            found = part.candidates(query, EXTRA * k + 1 + int(np.ceil(share * len(some))), int(np.ceil(COLLISIONS * part.lines.shape[1])))
            seen += len(found)
            entries, scores = self._top(query, np.concatenate([entries, some[found]]), np.concatenate([scores, part.vectors[found] @ query]), k)
        return *self._best(query_id, query, entries, k), seen

    def fitted(self, ids: np.ndarray, queries: np.ndarray, k: int) -> float:
        """The least of SHARES that finds RECALL of the k nearest of SAMPLE of the queries."""
        some = np.unique(np.linspace(0, len(ids) - 1, min(SAMPLE, len(ids))).astype(int))
        every = np.arange(len(self.vectors))
        exact = [set(self._best(ids[i], queries[i], self._top(queries[i], every, self.vectors @ queries[i], k)[0], k)[0].tolist()) for i in some]
        wanted = sum(map(len, exact))
        for share in SHARES[:-1]:
            hits = sum(len(e & set(self.search(ids[i], queries[i], k, share)[0].tolist())) for e, i in zip(exact, some))
            if hits >= RECALL * wanted:
                return share
        return SHARES[-1]


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each row where is_query."""
    rows = vectors.withColumn("_q", is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col("_q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("_v")), F.lit(False))).withColumn("_dim", F.size("_v"))
    counted = rows.agg(F.count("*"), F.count_if("_q")).first()
    n_blocks, q_blocks = -(-counted[0] // block) or 1, -(-counted[1] // queries) or 1
    own = F.xxhash64("vec_id", "_v")
    base = rows.select("_dim", "vec_id", "_v", F.pmod(own, F.lit(n_blocks)).alias("_b"), F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)")).alias("_qb"))
    asked = rows.filter("_q").select("_dim", F.col("vec_id").alias("query_id"), "_v", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("_b"), F.pmod(own, F.lit(q_blocks)).alias("_qb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            dim = left.column("_dim")[0].as_py()
            index = Index(left.column("vec_id").to_numpy(), _matrix(left.column("_v"), dim))
            ids, asked_for = right.column("query_id").to_numpy(), _matrix(right.column("_v"), dim)
            share = index.fitted(ids, asked_for, k)
            for q, vector in zip(ids, asked_for):
                found, scores, _ = index.search(q, vector, k, share)
                out_q.append(np.full(len(found), q))
                out_v.append(found)
                out_s.append(scores)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
        return pa.table({"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_v, pa.int64()), "score": cat(out_s, pa.float64())})

    keys = ["_dim", "_b", "_qb"]
    found = base.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
