"""Vector distances, search and quantisation; text chunks and similarity."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = re.compile(r"\w+").findall


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(1 - F.try_divide(dot(a, b), n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean, "dot": lambda a, b: -dot(a, b)}


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows: a top-k of each partition, then of those."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(DISTANCES[metric](F.col(vector_col), q), 6).alias("distance")).orderBy("distance", id_col).limit(k)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", levels: int = 255) -> DataFrame:
    """id, pos, code: each component between its column's least and greatest as a byte."""
    parts = vectors.select(id_col, F.posexplode(vector_col).alias("pos", "x"))
    bounds = parts.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row for each dimension
    share = F.try_divide((F.col("x") - F.col("lo")).cast("double"), (F.col("hi") - F.col("lo")).cast("double"))
    return parts.join(F.broadcast(bounds), "pos").select(id_col, "pos", F.floor(F.coalesce(share, F.lit(0.0)) * levels).cast("int").alias("code"))


def mean_vector(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: the mean vector."""
    m = vectors.select(F.posexplode(vector_col).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    return m.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))


class InvertedLists:
    """IVF index: centroids of a bounded sample, every row in its nearest centroid's list.

    A search probes the nearest lists, and then every other list that can hold a
    nearer row than those found, so that its result is that of brute force. That
    rests on the triangle inequality: with other metrics than euclidean all lists
    are read.
    """

    def __init__(self, vectors: DataFrame, lists: int = 16, sample: int = 2000, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.id_col, self.vector_col = id_col, vector_col
        rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("_v")).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
        x = np.array([r["_v"] for r in rows])
        centres = x[:lists].copy()
        for _ in range(rounds):
            own = ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
            for k in range(len(centres)):
                if (own == k).any():
                    centres[k] = x[own == k].mean(0)
        self.centres = centres
        c = F.array(*[F.struct(euclidean(F.col(vector_col), F.array(*[F.lit(float(v)) for v in centre])).alias("d"), F.lit(k).alias("k")) for k, centre in enumerate(centres)])
        nearest_centre = F.array_min(c)
        self.table = vectors.withColumn("_list", nearest_centre.getField("k"))
        reach = vectors.select(nearest_centre.alias("c")).groupBy("c.k").agg(F.max(F.when(~F.isnan("c.d"), F.col("c.d"))).alias("r")).collect()  # a row for each list
        self.radii = {r["k"]: r["r"] for r in reach if r["r"] is not None}

    def search(self, query: list[float], k: int, probes: int = 4, metric: str = "euclidean") -> DataFrame:
        if metric != "euclidean":
            return nearest(self.table, query, k, metric, self.id_col, self.vector_col)
        gaps = np.sqrt(((self.centres - np.array(query, float)) ** 2).sum(-1))
        order = gaps.argsort(kind="stable").tolist()
        of = lambda lists: nearest(self.table.filter(F.col("_list").isin(lists)), query, k, metric, self.id_col, self.vector_col)
        found = [r["distance"] for r in of(order[:probes]).collect()]
        # distances are rounded to 6 digits: ties count
        limit = found[-1] + 2e-6 if len(found) == k and not np.isnan(found[-1]) else float("inf")
        return of(order[:probes] + [i for i in order[probes:] if gaps[i] - self.radii.get(i, -np.inf) <= limit])


class ProductQuantiser:
    """Codes of vectors by parts: each of so many equal parts is the number of its nearest centroid, the first of equally near ones.

    Centroids of a part are those of the rows with the least ids, a bounded number.
    """

    def __init__(self, vectors: DataFrame, parts: int = 8, centroids: int = 16, id_col: str = "vec_id", vector_col: str = "embedding"):
        if not 0 < centroids <= 256:
            raise ValueError("a code is one byte")
        self.id_col, self.vector_col = id_col, vector_col
        rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("v")).orderBy(id_col).limit(centroids).collect()
        book = np.array([r["v"] for r in rows])
        if book.shape[1] % parts:
            raise ValueError("parts must be equally long")
        self.parts, self.width, self.book = parts, book.shape[1] // parts, book.reshape(len(rows), parts, -1)

    def codes(self, vectors: DataFrame) -> DataFrame:
        """id and codes (an integer for each part)."""

        @F.pandas_udf("array<int>")
        def encode(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), float).reshape(len(v), self.parts, self.width)
            gaps = np.stack([((x - c[None]) ** 2).sum(-1) for c in self.book], -1)
            return pd.Series(list(gaps.argmin(-1).astype(np.int32)))

        return vectors.select(self.id_col, encode(F.col(self.vector_col)).alias("codes"))

    def decoded(self, codes: DataFrame) -> DataFrame:
        """id and vector: the centroids that the codes name, one after another."""
        book = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in self.book[c, p]]) for c in range(len(self.book))]) for p in range(self.parts)])
        return codes.select(self.id_col, F.flatten(F.transform("codes", lambda c, p: F.get(F.get(book, p), c))).alias("vector"))

    def search(self, codes: DataFrame, query: list[float], k: int) -> DataFrame:
        """The k nearest by the distance of the query to the coded vectors, from one table of its distances to all centroids."""
        q = np.array(query, float).reshape(self.parts, self.width)
        table = ((self.book - q[None]) ** 2).sum(-1).T
        lut = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
        d = F.sqrt(F.aggregate(F.transform("codes", lambda c, p: F.get(F.get(lut, p), c)), F.lit(0.0), lambda a, b: a + b))
        return codes.select(self.id_col, F.round(d, 6).alias("distance")).orderBy("distance", self.id_col).limit(k)


def duplicates(items: DataFrame, id_col: str, name_col: str, vector_col: str, least_cosine: float, least_name: float) -> DataFrame:
    """a, b, cosine, name: pairs of a catalog (a table of names, which is small) alike both in vector and in name."""
    side = lambda n: items.select(F.col(id_col).alias(n), F.col(name_col).alias(f"_{n}n"), F.col(vector_col).alias(f"_{n}v"))
    # names that are alike share a letter pair: an equality join, not all pairs
    grams = lambda n: side(n).withColumn("_g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(f"_{n}n") - 1, F.lit(1))), lambda i: F.substring(F.col(f"_{n}n"), i, F.lit(2))))))
    met = grams("a").join(grams("b"), "_g").filter("a < b").drop("_g").dropDuplicates(["a", "b"])
    met = met.select("a", "b", F.round(1 - cosine_distance(F.col("_av"), F.col("_bv")), 6).alias("cosine"), F.round(similar_names(F.col("_an"), F.col("_bn")), 6).alias("name"))
    return met.filter((F.col("cosine") >= least_cosine) & (F.col("name") >= least_name))


def chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, chunk: pieces of size characters that start size - overlap apart; the last may be shorter."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n, step = F.length(text_col), size - overlap
    last = F.greatest(F.ceil((n - overlap) / step) - 1, F.lit(0)).cast("int")
    pos = F.when(n > 0, F.sequence(F.lit(0), last))
    return docs.select(id_col, text_col, F.explode(pos).alias("pos")).select(id_col, "pos", F.substring(F.col(text_col), F.col("pos") * step + 1, F.lit(size)).alias("chunk"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, chunk: the paragraphs of a text, those without text left out."""
    parts = F.filter(F.split(text_col, r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 0)
    return docs.select(id_col, F.posexplode(parts).alias("pos", "chunk"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """id, pos, chunk: whole sentences packed into chunks of at most size characters, where one sentence is not longer."""
    parts = F.filter(F.split(text_col, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)

    def pack(done: Column, s: Column) -> Column:
        fits = (F.size(done) > 0) & (F.length(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))) + 1 + F.length(s) <= size)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), s)))
        return F.when(fits, joined).otherwise(F.concat(done, F.array(s)))

    packed = F.aggregate(parts, F.array().cast("array<string>"), pack)
    return docs.select(id_col, F.posexplode(packed).alias("pos", "chunk"))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Bag of words hashed (the first 8 hex digits of their md5) into so many places, at unit length; zeros without words. Runs in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dims))
        for row, t in zip(out, texts):
            at = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in WORDS(t.lower())] if t else []
            row[:] = np.bincount(at, minlength=dims) if at else 0
        return pd.Series(list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)))

    return embed(text)


def without_tags(markup: Column) -> Column:
    """Text outside of <...>; a stray > goes as well."""
    return F.regexp_replace(F.regexp_replace(markup, "<[^>]*>?", ""), ">", "")


def similar_names(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return 1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double"))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def similar_users(items: DataFrame, user: str, item: str) -> DataFrame:
    """u, v, sim: Jaccard similarity of all pairs of users (u < v) that share an item.

    Equality joins alone: users of the same set of items are one class, classes
    meet on an item, and users meet by their classes. The result has a row for
    each pair, which is quadratic in users.
    """
    sets = items.groupBy(F.col(user).alias("u")).agg(F.array_sort(F.collect_set(item)).alias("kinds")).filter(F.size("kinds") > 0)
    classes = sets.select("kinds").distinct()
    side = lambda n: classes.select(F.col("kinds").alias(n), F.explode("kinds").alias("_item"))
    met = side("ka").join(side("kb"), "_item").groupBy("ka", "kb").agg(F.count("*").alias("common"))
    sims = met.select("ka", "kb", F.round(F.col("common") / (F.size("ka") + F.size("kb") - F.col("common")), 6).alias("sim"))
    a, b = sets.select("u", F.col("kinds").alias("ka")), sets.select(F.col("u").alias("v"), F.col("kinds").alias("kb"))
    return a.join(sims, "ka").join(b, "kb").filter("u < v").select("u", "v", "sim")


def top_of_each(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
