"""Shared helpers: table reading, size-checked joins, Arrow text buffers, and
vectorised word hashing.

Word hashing works on the UTF-8 bytes of a slice of documents at a time: a
polynomial prefix sum (mod 2**64) gives every word's hash without a Python loop
over words; ``mix`` finalises it.
"""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table

#: bytes of text that are hashed at once; a longer document is a slice of its own
SLICE_BYTES = 1 << 18
#: a side of a join is broadcast only up to this many bytes, by its counted rows
BROADCAST_BYTES = 32 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SHINGLE = 0xD1B54A32D192ED03


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back."""
    return scratch_table(df.sparkSession, df, name, compression=compression)


def small_side(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df`` with a broadcast hint if its rows fit ``BROADCAST_BYTES``; unchanged (a
    shuffled join) beyond that.  Rows of one size are counted; where a row's size varies
    (arrays, texts), ``row_bytes`` is a column and the rows' own sizes are summed.  Call it
    on staged tables, whose count comes from the file footers."""
    if isinstance(row_bytes, Column):
        size = df.agg(F.sum(row_bytes)).first()[0] or 0
    else:
        size = df.count() * row_bytes
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def bytes_of(*columns: str, fixed: int = 64, **arrays: int) -> Column:
    """Size of a row: ``fixed``, the texts of ``columns``, and so many bytes an element of
    each of ``arrays``; nulls are empty."""
    size = F.lit(fixed)
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    for c, each in arrays.items():
        size = size + F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * each
    return size


def has_words(col):
    """True if the text holds anything but white space ``[\\x20\\x09-\\x0D]``."""
    return F.coalesce(col.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (i, j) of documents of at most ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply-xorshift) on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SLICE_BYTES + 1:  # a very long document: not kept
        return _power(_BASE, n), _power(pow(_BASE, -1, 1 << 64), n)
    if len(_POWERS[0]) < n:
        _POWERS[:] = [_power(_BASE, SLICE_BYTES + 1), _power(pow(_BASE, -1, 1 << 64), SLICE_BYTES + 1)]
    return _POWERS[0], _POWERS[1]


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _WS):
    """Maximal runs of non-separator bytes, never across documents: byte starts, byte
    ends, and the first run of each document (with the total as last entry)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the byte spans from ``starts`` to each of ``ends``."""
    n = len(data)
    if n == 0:
        return [np.zeros(0, np.uint64) for _ in ends]
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return [mix((total[e] - total[starts]) * inverse[starts]) for e in ends]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of documents (offsets relative to
    ``data``): hashes, and :func:`spans`.  ``lower`` maps A-Z to a-z."""
    starts, ends, first = spans(data, offsets)
    return span_hashes(_LOWER[data] if lower else data, starts, ends)[0], starts, ends, first


def run_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from ``begin`` to ``end``, by one prefix sum."""
    power, inverse = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:len(hashes)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (order-sensitive)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(size):
        factor = factor * _SHINGLE % (1 << 64)
        out += hashes[j:n + j] * np.uint64(factor)
    return mix(out)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` (longs): rows
    (node, component) with the smallest node of each component, for every node
    that has an edge.

    Alternates hooking to the smallest neighbouring label with pointer jumping;
    each round is a Parquet stage in the shared folder, so lineage stays short
    and nothing but a count reaches the driver.  Label rows are pre-aggregated
    (``min``) before the shuffle, so a hub's edges never meet in one task.
    """
    both = stage(edges.select("a", "b").union(edges.selectExpr("b AS a", "a AS b")).distinct(), f"{name}-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        # smallest label among a node's neighbours
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        low = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("low"))
        # the old label's root learns the lower label as well (hooking) ...
        hook = (low.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("to")))
        hooked = low.join(hook, low.component == hook.root).select(
            "node", F.col("component").alias("old"), F.least("low", "to").alias("low"))
        # ... and every label is replaced by its own label (jump)
        jump = hooked.select(F.col("node").alias("root2"), F.col("low").alias("jump"))
        new = stage(hooked.join(jump, hooked.low == jump.root2, "left").select(
            "node", "old", F.least("low", "jump").alias("component")), f"{name}-{step}")
        if new.where("component <> old").limit(1).count() == 0:
            return new.select("node", "component")
        labels = new.select("node", "component")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine (``public_tokenizers.path``)."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
