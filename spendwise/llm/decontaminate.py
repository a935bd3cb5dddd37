"""Benchmark decontamination in DataFrame and SQL functions only.

A document window is as long as a benchmark item (in words) and starts where a
shingle that it shares with an item of that length says that the item would start.
(A window that is similar enough shares shingles, so none is missed for want of
an alignment.)  Windows and items get 64-bit SimHash fingerprints of their
shingles.  Fingerprints are cut into ``BLOCKS`` blocks; within ``RADIUS`` differing
bits, some block differs in at most RADIUS // BLOCKS bits, so the items' block
values are spread to all values that close and windows join on (length, block,
value): every pair within the radius meets.  Pairs within the radius are then
verified by the exact similarity of their shingles, weighted by multiplicity
(sum of minima over sum of maxima).

The benchmark's shingles and fingerprints and the documents' window lists are broadcast
only if the sizes of their rows, lists included, add up to less than the bound in
``common``; beyond it the same joins are shuffled.  Words
are runs of letters and digits, lower-cased.  Defined results: null or wordless
texts and items match nothing; an item of fewer words than a shingle is one
shingle; a document shorter than an item is one window; repeated rows and items
give one row per (id, item); null ids are left out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, small_side, stage

SIZE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 23
#: bytes of a struct of two integers within an array
PAIR_BYTES = 40


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words of the array column ``words``."""
    each = ", ".join(f"{words}[i + {j}]" if j else f"{words}[i]" for j in range(size))
    return F.expr(f"IF(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64({each})), "
                  "CAST(array() AS array<bigint>))")


def _own_shingles(words: str, length: str) -> Column:
    """Shingles of a window that stands for an item of ``length`` words."""
    out = shingles_of(words, SIZE)
    for n in range(1, SIZE):
        out = F.when(F.col(length) == n, shingles_of(words, n)).otherwise(out)
    return out


def simhash_of(shingles: str) -> Column:
    return F.expr(f"""aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) ->
        IF(aggregate({shingles}, 0, (s, h) -> s + IF((shiftright(h, b) & 1L) = 1L, 1, -1)) > 0, acc | shiftleft(1L, b), acc))""")


def _block(fingerprint: str) -> Column:
    """(block number, value) pairs of a fingerprint."""
    width = BITS // BLOCKS
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), k -> named_struct('k', k, 'v', shiftrightunsigned({fingerprint}, k * {width}) & {(1 << width) - 1}L))")


def _flips() -> list[int]:
    """Masks of the block values within RADIUS // BLOCKS bits."""
    return [m for m in range(1 << (BITS // BLOCKS)) if bin(m).count("1") <= RADIUS // BLOCKS]


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of minima over sum of maxima of the multiplicities of two shingle arrays."""
    low = f"""aggregate(array_distinct(array_intersect({a}, {b})), 0, (s, x) ->
        s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"""
    return F.expr(f"({low}) / CAST(size({a}) + size({b}) - ({low}) AS double)")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, start_word, distance, similarity): for each document and benchmark
    item that it holds, the most similar window (the first of equals)."""
    items = (benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("w"))
             .where("item IS NOT NULL AND size(w) > 0").withColumn("len", F.size("w"))
             .withColumn("sh", _own_shingles("w", "len")).withColumn("fp", simhash_of("sh")))
    items = stage(items.select("item", "len", "sh", "fp"), "dec-items")
    known = stage(items.select("len", F.posexplode("sh").alias("q", "h")).groupBy("h")
                  .agg(F.collect_set(F.struct("len", "q")).alias("at"), F.min(F.least("len", F.lit(SIZE))).alias("n")), "dec-shingles")
    sizes = sorted(r[0] for r in items.select(F.least("len", F.lit(SIZE))).distinct().collect())  # SIZE values at most

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    source = source.select("id", F.xxhash64("t").alias("tkey"), words_of(F.col("t")).alias("w"))
    windows = None
    for n in sizes:
        hits = (source.select("id", "tkey", F.size("w").alias("total"), F.posexplode(shingles_of("w", n)).alias("p", "h"))
                .join(small_side(known.where(F.col("n") == n), bytes_of(at=PAIR_BYTES)), "h")
                .select("id", "tkey", "total", "p", F.explode("at").alias("at"))
                .select("id", "tkey", F.col("at.len").alias("len"),
                        F.greatest(F.lit(0), F.least(F.col("p") - F.col("at.q"), F.col("total") - F.col("at.len"))).alias("start")))
        windows = hits if windows is None else windows.union(hits)
    if windows is None:  # an empty benchmark
        windows = source.select("id", "tkey", F.size("w").alias("len"), F.lit(0).alias("start")).where(F.lit(False))
    windows = stage(windows.distinct().groupBy("id", "tkey").agg(F.collect_list(F.struct("len", "start")).alias("at")), "dec-windows")

    own = source.join(small_side(windows, bytes_of("id", at=PAIR_BYTES)), ["id", "tkey"]).distinct()
    prints = (own.select("id", "tkey", "w", F.explode("at").alias("at"))
              .select("id", "tkey", F.col("at.len").alias("len"), F.col("at.start").alias("start"),
                      F.expr("slice(w, at.start + 1, at.len)").alias("v"))
              .withColumn("sh", _own_shingles("v", "len")).where("size(sh) > 0").select("id", "len", "start", "sh", simhash_of("sh").alias("fp")))
    prints = stage(prints, "dec-prints")
    blocks = (items.select("item", "len", "fp", F.explode(_block("fp")).alias("b"))
              .select("item", "len", "fp", F.col("b.k").alias("k"), F.col("b.v").alias("v"), F.explode(F.array([F.lit(m) for m in _flips()])).alias("m"))
              .select("item", "len", F.col("fp").alias("item_fp"), "k", F.col("v").bitwiseXOR(F.col("m").cast("long")).alias("v")))
    blocks = stage(blocks, "dec-blocks")
    met = (prints.select("id", "len", "start", "fp", F.explode(_block("fp")).alias("b"))
           .select("id", "len", "start", "fp", F.col("b.k").alias("k"), F.col("b.v").alias("v"))
           .join(small_side(blocks, bytes_of("item", fixed=80)), ["len", "k", "v"])
           .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("distance") <= RADIUS)
           .select("id", "len", "start", "fp", "item", "distance").distinct())
    near = (met.join(prints, ["id", "len", "start", "fp"])
            .join(small_side(items.select("item", F.col("sh").alias("item_sh")), bytes_of("item", item_sh=8)), "item")
            .withColumn("similarity", weighted_similarity("sh", "item_sh")).where(F.col("similarity") >= similarity))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", "distance"))
    return near.groupBy("id", "item").agg(best.alias("b")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.start").alias("start_word"),
        F.col("b.distance").alias("distance"), (-F.col("b.s")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = stage(leaks(docs, benchmark, id_col, text_col, **params).select(F.col(id_col).alias("__drop")).distinct(), "dec-drop")
    return docs.join(small_side(found, bytes_of("__drop")), F.col(id_col) == F.col("__drop"), "left_anti")
