"""Exact top-k inner product by an impact-ordered, score-at-a-time index.

Vectors are quantised to integers.  They are dealt to shards of about ``SHARD``
vectors, queries to blocks of about ``QUERIES``; each (shard, block) cell is one
group.  A shard keeps the postings of each dimension together, with the dimension's
largest and least component: for a query, a dimension's impact is its largest
contribution above its least one.  Dimensions are processed by descending impact, a
batch at a time, adding to accumulators.  What the unprocessed ones can still add
bounds every vector's score: processing stops once that bound leaves few vectors that
could be among the k best, and those are scored exactly.  Cells' best rows are
merged per query.

The work grows as queries times vectors, since every pair is a candidate.  A cell
holds one shard and one block whatever the tables' sizes.

Defined results: null ids, null vectors and vectors with a null or non-finite
component take no part; a shorter vector counts as padded with zeros; repeated
rows count once, and rows with the query's id are not its candidates; ties go to
the smaller id.  Where a shard's scores of a query could pass 51 bits (components beyond
about 2**21), accumulators are not exact: all its rows are then rescored in whole numbers,
and a score beyond 64 bits is held at the limit.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
SHARD, QUERIES = 2048, 2048
#: dimensions processed between two looks at the bound
BATCH = 16
LONG = (-(1 << 63), (1 << 63) - 1)


class ImpactIndex:
    """Postings of a shard by dimension, with each dimension's span of components."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.n, self.dims = vectors, *vectors.shape
        self.values = np.ascontiguousarray(vectors.T, np.float64)
        high, low = vectors.max(0, initial=LONG[0]), vectors.min(0, initial=LONG[1])
        self.largest = max(abs(int(high.max())), abs(int(low.min()))) if self.n else 0
        self.span = high.astype(np.float64) - low

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of vectors that hold the k best outside ``skip``
        (and possibly more)."""
        if self.largest * sum(abs(c) for c in query.tolist()) >= 1 << 51:  # bounds are sums in doubles
            maybe = np.flatnonzero(~skip)
            score = self.vectors[maybe].astype(object) @ query.astype(object)
            return maybe, np.array([min(max(s, LONG[0]), LONG[1]) for s in score], np.int64)
        q = query.astype(np.float64)
        impact = np.abs(q) * self.span
        order = np.argsort(-impact, kind="stable")
        left = np.append(np.cumsum(impact[order][::-1])[::-1], 0.0)  # what the dimensions from here on can add
        part = np.zeros(self.n)
        part[skip] = -np.inf
        maybe = np.arange(self.n)
        for at in range(0, self.dims, BATCH):
            now = order[at:at + BATCH]
            part += q[now] @ self.values[now]
            if self.n > k:
                floor = np.partition(part, self.n - k)[self.n - k]
                maybe = np.flatnonzero(part + left[min(at + BATCH, self.dims)] >= floor)  # nobody else can be among the k best
                if len(maybe) <= max(4 * k, self.n // 32):
                    break
        maybe = maybe[~skip[maybe]]
        return maybe, self.vectors[maybe] @ query


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * component), of the rows that take part, without repeats."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return (vectors.select(F.col(id_col).alias("id"), F.when(x.isNotNull() & sound, F.transform(x, lambda e: F.floor(e.cast("double") * scale))).alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL").distinct())


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of an Arrow column of lists, padded with zeros."""
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.repeat(np.arange(len(lists)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def dealt(vectors: DataFrame, queries: DataFrame, shard: int = SHARD, block: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Vectors by their shard and every block, queries by their block and every shard."""
    shards, blocks = max(1, -(-vectors.count() // shard)), max(1, -(-queries.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    return left, right


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised ``vectors(id, v)`` and ``queries(id, v)``."""
    left, right = dealt(vectors, queries, shard, block)

    def cell(own: pa.Table, asked: pa.Table) -> pa.Table:
        query, row, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = own.sort_by("id")  # row numbers then order ties
        if own.num_rows and asked.num_rows:
            lists = [t["v"].combine_chunks() for t in (own, asked)]
            dims = max(1, *(int(pc.max(pc.list_value_length(x)).as_py()) for x in lists))
            vectors, queries_ = (_matrix(x, dims) for x in lists)
            ids, wanted, index = own["id"].to_numpy(), asked["id"].to_numpy(), ImpactIndex(vectors)
            for i, q in enumerate(queries_):
                found, points = index.search(q, k, ids == wanted[i])
                best = np.lexsort((found, ~points))[:k]
                query.append(np.full(len(best), i))
                row.append(found[best])
                score.append(points[best])
        return pa.table([asked["id"].take(pa.array(np.concatenate(query))), own["id"].take(pa.array(np.concatenate(row))),
                         pa.array(np.concatenate(score))], ["query_id", "vec_id", "score"])

    kind = dict(vectors.dtypes)["id"]
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        cell, f"query_id {kind}, vec_id {kind}, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
