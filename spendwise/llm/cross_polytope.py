"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector by pseudo-rotations, each three rounds of random
signs and a fast Hadamard transform, and takes the nearest signed axis: one of
twice the dimensions.  ``functions`` rotations are chained so that a bucket holds
about ``BUCKET`` vectors (their number follows from the row count; the last one is
cut to as many axes as are needed).  A query probes, in each of ``TABLES`` tables,
the ``PROBES`` buckets per function whose axes cost it least.  All candidates of
the probed buckets are reranked by their exact cosines; a query that met fewer
than k candidates is compared with all rows.

Every row is indexed.  Exact copies of a vector score alike, and ties go to the
smaller id, so of each distinct vector the k + 1 smallest ids stand for all.
Buckets are counted; one with more than ``CHUNK`` vectors or ``BLOCK`` queries is
cut into cells of (chunk of vectors, block of queries), so that no task holds a
whole hot bucket.  A cell returns k rows per query.

Defined results: null ids, and vectors that are null, zero or hold null or
non-finite components, take no part; a shorter vector counts as padded with zeros;
repeated rows count once; rows with the query's id are not its candidates; an
empty table gives no rows; other columns are ignored.  Vectors are scaled by powers
of two before squares are summed, so that no component overflows.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stage

TABLES, PROBES, SEED = 4, 32, 20240613
BUCKET, CHUNK, BLOCK = 1024, 1024, 512


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, their largest component in [0.5, 1)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hash:
    """``tables`` chains of pseudo-rotations of ``dims`` (padded to a power of two)."""

    def __init__(self, dims: int, rows: int, tables: int = TABLES, bucket: int = BUCKET, seed: int = SEED):
        self.dims = 1 << max(0, dims - 1).bit_length()
        self.tables, need, axes = tables, max(1, -(-rows // bucket)), 2 * self.dims
        self.width = [self.dims]  # axes of each chained function
        while need > axes and self.dims > 1:
            need = -(-need // axes)
            self.width.append(min(self.dims, 1 << max(0, -(-need // 2) - 1).bit_length()))
        self.signs = np.random.RandomState(seed).choice([-1.0, 1.0], (tables, len(self.width), 3, self.dims))

    def rotated(self, x: np.ndarray, t: int, f: int) -> np.ndarray:
        """Coordinates along the signed axes: first the positive ones, then the negative."""
        for signs in self.signs[t, f]:
            x = hadamard(x * signs)
        x = x[:, :self.width[f]]
        return np.concatenate([x, -x], 1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows x tables) bucket numbers."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for f, w in enumerate(self.width):
                out[:, t] = out[:, t] * 2 * w + self.rotated(x, t, f).argmax(1)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(rows x tables x at most count ** functions' share) bucket numbers of least cost:
        the sum over functions of the squared distance behind the nearest axis."""
        out = []
        for t in range(self.tables):
            cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for f, w in enumerate(self.width):
                along = self.rotated(x, t, f)
                axes = np.argsort(-along, axis=1, kind="stable")[:, :count]
                behind = (along.max(1, keepdims=True) - np.take_along_axis(along, axes, 1)) ** 2
                cost = (cost[:, :, None] + behind[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * 2 * w + axes[:, None, :]).reshape(len(x), -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :count * (f + 1)]
                cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
            out.append(code)
        return np.stack(out, 1)


def sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda e: e != 0), F.lit(False))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, without repeats."""
    v = F.col(vector_col)
    return (vectors.select(F.col(id_col).alias("id"), F.when(sound(v), v).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").distinct())


def _cells(vectors: DataFrame, asked: DataFrame, dims: int, k: int, chunk: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): each cell's k best, from vectors(t, b, id, v) and
    asked(t, b, id, v) that meet in (t, b)."""
    load = (vectors.groupBy("t", "b").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
            .unionByName(asked.groupBy("t", "b").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
            .groupBy("t", "b").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"), F.ceil(F.sum("m") / block).cast("int").alias("blocks"))
            .where("chunks > 1 OR blocks > 1"))
    load = small_side(stage(load.where("chunks > 0 AND blocks > 0"), "ann-load"), 32)

    def dealt(rows, own, parts, other, copies):
        rows = rows.join(load, ["t", "b"], "left")
        rows = rows.withColumn(own, F.coalesce(F.pmod(F.xxhash64("id", "v"), F.col(parts)), F.lit(0)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))).drop("chunks", "blocks")

    left = dealt(vectors, "chunk", "chunks", "block", "blocks").groupBy("t", "b", "chunk", "block")
    right = dealt(asked, "block", "blocks", "chunk", "chunks").groupBy("t", "b", "chunk", "block")

    def cell(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(queries):
            ids, x, q = own["id"].to_numpy(), scaled(matrix(own["v"], dims)), scaled(matrix(queries["v"], dims))
            length, reach = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            for i, qid in enumerate(queries["id"].to_numpy()):
                rough = (x @ q[i]) / (length * reach[i])
                rough[ids == qid] = -np.inf
                least = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -2.0
                row = np.flatnonzero(rough >= max(least, -2.0) - 1e-9)
                score = np.clip((x[row] * q[i]).sum(1) / (length[row] * reach[i]), -1, 1)  # one order of summation in every cell
                best = np.lexsort((ids[row], -score))[:k]
                found += [(qid, ids[row[j]], float(score[j])) for j in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    kind = dict(vectors.dtypes)["id"]
    return left.cogroup(right).applyInPandas(cell, f"query_id {kind}, vec_id {kind}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, a candidate that was met several times once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES,
            bucket: int = BUCKET, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors(id, v)`` and ``queries(id, v)`` as
    :func:`usable` gives them."""
    copies = Window.partitionBy("v").orderBy("id")
    base = stage(vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "v"), "ann-vectors")
    asked = stage(queries, "ann-queries")
    rows, dims = base.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(dims or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    hashing = Hash(dims, rows, tables, bucket)

    @F.pandas_udf("array<long>")
    def hashed(v: pd.Series) -> pd.Series:
        return pd.Series(list(hashing.buckets(scaled(matrix(v, hashing.dims)))))

    @F.pandas_udf("array<array<long>>")
    def probed(v: pd.Series) -> pd.Series:
        x = scaled(matrix(v, hashing.dims))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        return pd.Series([list(p) for p in hashing.probes(x, probes)], dtype=object)

    left = stage(base.withColumn("h", hashed("v")), "ann-hashes").select("id", "v", F.posexplode("h").alias("t", "b"))
    right = (stage(asked.withColumn("h", probed("v")), "ann-probes").select("id", "v", F.posexplode("h").alias("t", "h"))
             .select("id", "v", "t", F.explode("h").alias("b")))
    best = stage(_best(_cells(left, right, hashing.dims, k, chunk, block), k), "ann-found")
    met = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("met")).where(F.col("met") >= k).select("id")
    few = stage(asked.join(met, "id", "left_anti"), "ann-few")
    if few.limit(1).count():  # against all rows, in blocks
        every = _cells(base.selectExpr("id", "v", "-1 AS t", "0L AS b"), few.selectExpr("id", "v", "-1 AS t", "0L AS b"), hashing.dims, k, chunk, block)
        best = best.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(_best(every, k))
    return best
