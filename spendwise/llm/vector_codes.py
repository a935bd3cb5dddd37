"""Product-quantisation codes of vectors, trained by Lloyd's rounds over cover trees.

Components become integers; vectors are cut into equal consecutive parts, each
with a codebook of its own.  The vectors of a Spark partition are cut into shards
of at most ``SHARD``; each part of a shard gets a cover tree, written once: a
node's points lie within its radius of its centre, children halve the covering
radius, centres of siblings are further apart than it, and a node is its own first
child.  Every node carries the sum and the count of its points.  In a round, a
node whose nearest entry beats every other by more than twice its radius gives its
whole subtree to that entry (triangle inequality); only ambiguous nodes descend,
down to exact integer comparisons of the points in a leaf.  A task returns sums
and counts by (part, entry) only, so that a round moves a codebook's size per task.

Codebooks (parts x entries, independent of the data's size) are the one thing that
passes through the driver.  Arithmetic is exact in 64-bit integers.

Defined results: rows whose vector is null or holds null or non-finite components
are left out; a shorter vector counts as padded with zeros to the longest one, and
that to a multiple of the parts; repeated rows count as often as they occur; a null
id comes last among the seeds, equal ids are ordered by their vectors; fewer rows
than entries give a shorter codebook; an empty table gives no rows; other columns
are ignored.  A scaled component of 2**26 or more would not fit the exact sums:
it ends the job with an error.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_side, stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SHARD, LEAF = 2048, 12
LIMIT = 1 << 26


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (points x entries), exact."""
    gap = points[:, None, :] - book[None]
    return np.einsum("ijk,ijk->ij", gap, gap)


class CoverTree:
    """Flat arrays: ``order`` (points by node), and per node its range of ``order``,
    its range of children, centre, radius and the sum of its points."""

    FIELDS = ("order", "begin", "end", "child", "children", "centre", "radius", "total")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        order = np.arange(len(points))
        begin, end, child, children, centre, radius = [], [], [], [], [], []

        def add(b: int, e: int, c: int) -> None:
            gap = points[order[b:e]] - points[c]
            begin.append(b)
            end.append(e)
            child.append(0)
            children.append(0)
            centre.append(c)
            radius.append(float(np.sqrt(np.einsum("ij,ij->i", gap, gap).max())))

        if len(points):
            add(0, len(points), 0)
        at = 0
        while at < len(begin):  # breadth first, so that children are consecutive
            b, e, half = begin[at], end[at], radius[at] / 2
            if e - b > leaf and half > 0:
                rest, c, groups = order[b:e], centre[at], []
                while len(rest):
                    gap = points[rest] - points[c]
                    near = np.einsum("ij,ij->i", gap, gap) <= half * half
                    near |= rest == c
                    groups.append((c, rest[near]))
                    rest = rest[~near]
                    c = rest[0] if len(rest) else -1
                child[at], children[at] = len(begin), len(groups)
                for c, group in groups:
                    order[b:b + len(group)] = group
                    add(b, b + len(group), c)
                    b += len(group)
            at += 1
        begin, end = np.array(begin, np.int64), np.array(end, np.int64)
        total = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points[order], axis=0, out=total[1:])  # cumulative sums: a node's sum is a difference
        return cls(order=order.astype(np.int64), begin=begin, end=end, child=np.array(child, np.int64), children=np.array(children, np.int64),
                   centre=points[np.array(centre, np.int64)] if len(points) else points, radius=np.array(radius), total=total[end] - total[begin])

    def assign(self, points: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, entries) of whole subtrees, and (points, entries) of the rest: yields
        (kind, index, entry) with kind 0 for nodes and 1 for points."""
        front = np.arange(min(1, len(self.begin)))
        while len(front):
            near = np.sqrt(distances(self.centre[front], book).astype(np.float64))
            entry = near.argmin(1)
            best = near[np.arange(len(front)), entry]
            near[np.arange(len(front)), entry] = np.inf
            second = near.min(1)  # infinite if there is one entry only
            sure = second - best > 2 * self.radius[front] + 1e-9 * (1 + best + self.radius[front])
            if sure.any():
                yield 0, front[sure], entry[sure]
            front = front[~sure]
            inner = self.children[front] > 0
            ends = front[~inner]
            if len(ends):
                which = self.order[_ranges(self.begin[ends], self.end[ends])]
                yield 1, which, distances(points[which], book).argmin(1)
            front = front[inner]
            front = _ranges(self.child[front], self.child[front] + self.children[front])


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    skip = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) if len(size) else begin
    return skip + np.arange(size.sum() if len(size) else 0)


def _matrix(column: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * component), padded with zeros to ``dims`` columns."""
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    scaled = np.floor(flat * scale)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component is too large for exact sums: {np.abs(flat).max()} (limit {LIMIT // scale})")
    out = np.zeros((len(size), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), _ranges(np.zeros(len(size), np.int64), size)] = scaled.astype(np.int64)
    return out


def _sound(vector) -> F.Column:
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _pack(tree: CoverTree) -> bytes:
    parts = []
    for name in CoverTree.FIELDS:
        a = np.ascontiguousarray(getattr(tree, name))
        parts.append(np.array([*a.shape, *[0] * (2 - a.ndim)], np.int64).tobytes() + a.tobytes())
    return b"".join(parts)


def _unpack(raw: bytes) -> CoverTree:
    at, out = 0, {}
    for name in CoverTree.FIELDS:
        shape = np.frombuffer(raw, np.int64, 2, at)
        kind = np.float64 if name == "radius" else np.int64
        flat = name not in ("centre", "total")
        n = int(shape[0]) if flat else int(shape[0] * shape[1])
        out[name] = np.frombuffer(raw, kind, n, at + 16).reshape(-1 if flat else (int(shape[0]), int(shape[1])))
        at += 16 + 8 * n
    return CoverTree(**out)


def shards(vectors: DataFrame, dims: int, parts: int = PARTS, scale: int = SCALE, size: int = SHARD) -> DataFrame:
    """A row per shard of ``vectors(id, v, label)``: its ids, labels, points and trees."""
    kind = {f.name: f.dataType for f in vectors.schema}
    ids, labels = T.ArrayType(kind["id"]), T.ArrayType(kind["label"])
    schema = T.StructType([T.StructField("ids", ids), T.StructField("labels", labels), T.StructField("points", T.BinaryType()),
                           T.StructField("trees", T.ArrayType(T.BinaryType()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def shard(batch):
            points = _matrix(batch.column("v").combine_chunks(), dims, scale)
            trees = [_pack(CoverTree.build(p)) for p in np.split(points, parts, axis=1)] if dims else [b""] * parts
            one = pa.array([0, len(points)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, batch.column("id").combine_chunks()), pa.ListArray.from_arrays(one, batch.column("label").combine_chunks()),
                 pa.array([points.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "points", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if n and n + piece.num_rows > size:
                    yield shard(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield shard(pa.Table.from_batches(held))

    return vectors.select("id", "v", "label").mapInArrow(build, schema)


def _read(batch: pa.RecordBatch, i: int, dims: int, parts: int):
    points = np.frombuffer(batch.column("points")[i].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
    for p, raw in enumerate(batch.column("trees")[i]):
        yield p, np.ascontiguousarray(points[:, p * dims // parts:(p + 1) * dims // parts]), _unpack(raw.as_py())


def lloyd_round(staged: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one more round over the shards."""
    parts, entries, width = books.shape
    dims = parts * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, points, tree in _read(batch, i, dims, parts):
                    for kind, which, entry in tree.assign(points, books[p]):
                        np.add.at(total[p], entry, points[which] if kind else tree.total[which])
                        np.add.at(count[p], entry, 1 if kind else tree.end[which] - tree.begin[which])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at]), pa.array(list(total.reshape(-1, width)[at]), pa.list_(pa.int64()))],
                                         ["at", "n", "total"])

    found = staged.select("points", "trees").mapInArrow(sums, "at long, n long, total array<long>")
    each = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)]
    new = books.copy()
    for row in found.groupBy("at").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries rows at most
        new[divmod(row["at"], entries)] = [row[f"t{j}"] // row["n"] for j in range(width)]
    return new


def encode(staged: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector of the shards."""
    parts, entries, width = books.shape
    dims = parts * width
    kind = {f.name: f.dataType.elementType for f in staged.schema if f.name in ("ids", "labels")}
    schema = T.StructType([T.StructField("id", kind["ids"]), T.StructField("label", kind["labels"]), T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, points, tree in _read(batch, i, dims, parts) if dims else ():
                    for whole, which, entry in tree.assign(points, books[p]):
                        if not whole:
                            entry = np.repeat(entry, tree.end[which] - tree.begin[which])
                            which = tree.order[_ranges(tree.begin[which], tree.end[which])]
                        code[which, p] = entry
                    gap = points - books[p][code[:, p]]
                    error += np.einsum("ij,ij->i", gap, gap)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([bytes(c).hex() for c in code]), pa.array(error)], ["id", "label", "code", "error"])

    return staged.mapInArrow(codes, schema)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, shard: int = SHARD) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every kept vector, and the codebooks."""
    v = F.col(vector_col)
    kept = embeddings.select(F.col(id_col).alias("id"), F.when(_sound(v), v).alias("v"), F.col(label_col).alias("label")).where("v IS NOT NULL")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"].combine_chunks()
    seeds = _matrix(first, dims, scale) if len(first) else np.zeros((0, dims), np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2))
    staged = stage(shards(kept, dims, parts, scale, shard), "vector-trees")
    for _ in range(rounds if books.size else 0):
        books = lloyd_round(staged, books)
    return stage(encode(staged, books), "vector-codes"), books


def code_table(embeddings: DataFrame, **params) -> DataFrame:
    """The contract's columns: codes, errors, errors by label, digest of the codebooks."""
    codes, books = compress(embeddings, **params)
    by_label = stage(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vector-labels")
    widest = by_label.agg(F.max(F.octet_length(F.col("of").cast("string")))).first()[0] or 0
    return (codes.join(small_side(by_label, 64 + widest), F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB twin: every part against every entry in each round."""
    sql = [f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT i, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM v, range(0, {parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, x AS c FROM p WHERE i <= {entries})"""]
    for r in range(rounds + 1):
        sql.append(f"""a{r} AS MATERIALIZED (
  SELECT i, p, x, e, d FROM (
    SELECT p.i, p.p, p.x, b.e, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM p JOIN b{r} b USING (p)) QUALIFY row_number() OVER (PARTITION BY i, p ORDER BY d, e) = 1)""")
        if r < rounds:
            sql.append(f"""m{r} AS MATERIALIZED (
  SELECT p, e, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY j) AS c FROM (
    SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM a{r}, range(1, 1 + (SELECT max(len(x)) FROM p)) t(j) GROUP BY p, e, j) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    sql.append(f"""done AS (
  SELECT i, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY i),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM done JOIN v USING (i), sha""")
    return ",\n".join(sql)
