"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles (64-bit hashes).  Sets are put in
size bands; two sets that link lie in one band or in adjacent ones, so each set
takes part in its own band's instance and the next one's.  In the instance with
largest size U, two linked sets differ in at most k = 2U(den-num)/(den+num)
elements.  The domain is cut into n1 first-level parts of three second-level parts
each, with 2*n1 > k: some first-level part then has at most one difference, so
two of its three parts agree.  Each pair of parts of each first-level part is one
signature (the hash of the set's elements in those parts), and linked sets share
at least ``agree`` >= 1 of them.  Empty projections say nothing and are left out,
unless a set has ``agree`` or more of them: then all that it shares could be
empty, and it emits them too.  So no link is lost.

Identical sets are one class (fingerprint of 64 bits and size); only classes meet
in signature buckets.  A bucket first proposes its members' links to its smallest
member, then, in blocks of bounded size, a forest of pairs that would join what is
still apart; what these exact checks join is done.  Only pairs in a bucket that
are in different components by then are all compared, through an exact lower
bound of the difference (parity bitmaps) and then the exact sets.  So a group of
thousands of near copies costs a star and a forest, not all its pairs.  A bitmap has
about as many cells as its set has elements, so that long sets, too, are told apart
inside a block and no row is made of a pair that only shares a passage.

Defined results: null text and text without words are empty sets, linked with
nothing; a text of fewer words than a shingle is one shingle; repeated rows keep
their own output row; a null id never names a component unless all ids of it are
null.  Other columns are ignored (``component_of``) or kept (``keep_one``).
"""
from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, components, mix, shingles, slices, small_side, stage, words

WORDS, NUM, DEN = 4, 85, 100
#: least and most bits of a parity bitmap
BITMAP, WIDEST = 1024, 1 << 17
#: rows of a block in the comparison of what the stars left apart
BLOCK = 512
#: shingles of the sets that are held at once before their rows are handed on
SLICE_WORDS = 1 << 17


@lru_cache(maxsize=None)
def _bands(top: int, num: int, den: int) -> list[int]:
    """Largest size of each band, up to the band that holds ``top``."""
    out, low = [], 1
    while not out or out[-1] < top:
        out.append(low * den // num)
        low = out[-1] + 1
    return out


def band_of(n: int, num: int = NUM, den: int = DEN) -> tuple[int, list[int]]:
    bands = _bands(1 << max(10, n.bit_length()), num, den)
    return bisect_left(bands, n), bands


def shape(largest: int, num: int = NUM, den: int = DEN) -> tuple[int, int, int]:
    """k, number of first-level parts, and how many signatures linked sets share at least."""
    k = 2 * largest * (den - num) // (den + num)
    n1 = (k + 2) // 2
    if n1 >= 8:  # a margin, so that sets with that many empty projections are rare
        n1 += 2 + n1 // 100
    return k, n1, 3 * n1 - 2 * k if k <= n1 else 2 * n1 - k


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of a document's word hashes."""
    return np.unique(shingles(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def fingerprint(s: np.ndarray) -> int:
    """Of a set: its sum, mixed with its size, as a signed 64-bit number."""
    return int(mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray, cells: int = BITMAP) -> bytes:
    """Parity of the elements in each of ``cells`` cells (a power of two): sets that
    differ in d elements have bitmaps that differ in at most d bits."""
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def cells_of(n: int) -> int:
    """Bits of the bitmap of a set of n elements: n at least, so that it tells apart."""
    return min(max(BITMAP, 1 << max(n - 1, 0).bit_length()), WIDEST)


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, the wider ones folded to the narrowest one's cells."""
    words_ = [np.frombuffer(x, np.uint64) for x in bitmaps]
    least = min(map(len, words_))
    return np.stack([x if len(x) == least else np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in words_])


def signatures(s: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """PartEnum signatures of a sorted set, of both instances that it takes part in."""
    if not len(s):
        return s
    own, bands = band_of(len(s), num, den)
    out = []
    for band in (own, own + 1):
        if band >= len(bands):
            bands = _bands(bands[-1] + 1, num, den)
        k, n1, agree = shape(bands[band], num, den)
        if k == 0:
            continue  # only equal sets link
        part = ((s >> np.uint64(32)) * np.uint64(3 * n1)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, full = np.zeros(3 * n1, np.uint64), np.zeros(3 * n1, bool)
        at = part[start].astype(np.int64)
        sums[at] = np.add.reduceat(s, start)
        full[at] = True
        a, f = sums.reshape(n1, 3), full.reshape(n1, 3)
        left, right = [0, 0, 1], [1, 2, 2]  # the subsets of two of three parts
        sig = a[:, left] * np.uint64(0x9E3779B97F4A7C15) + a[:, right] * np.uint64(0xC2B2AE3D27D4EB4F)
        sig += mix(np.arange(3 * n1, dtype=np.uint64) + np.uint64(band << 32)).reshape(n1, 3)
        some = f[:, left] | f[:, right]
        if (~some).sum() >= agree:
            some[:] = True
        out.append(mix(sig[some]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(column: pa.Array, size: int, lower: bool):
    """(row, sorted set) for each text of an Arrow column."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        base = offsets[i]
        hashes, _, _, first = words(data[base:offsets[j]], offsets[i:j + 1] - base, lower)
        for k in range(i, j):
            yield k, shingle_set(hashes[first[k - i]:first[k - i + 1]], size)


def _by_slice(column: pa.Array, size: int, lower: bool):
    """The (row, sorted set) pairs of each slice of an Arrow column, as lists."""
    held, total = [], 0
    for k, s in _sets(column, size, lower):
        held.append((k, s))
        total += len(s)
        if total >= SLICE_WORDS:
            yield held
            held, total = [], 0
    if held:
        yield held


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, lower: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(len(s), fingerprint(s) if len(s) else None, bitmap(s, cells_of(len(s))) if len(s) else None)
                    for _, s in _sets(b.column(1), size, lower)]
            n, fp, bits = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()),
                                              pa.array(bits, pa.binary())], ["id", "n", "fp", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, fp long, bits binary")


def _signature_rows(docs: DataFrame, text_col: str, size: int, lower: bool, num: int, den: int) -> DataFrame:
    def run(batches):
        for b in batches:
            seen: set[int] = set()  # a batch emits a class once
            for held in _by_slice(b.column(0), size, lower):
                sigs, owner = [], []
                for _, s in held:
                    fp = fingerprint(s) if len(s) else None
                    if fp is None or fp in seen:
                        continue
                    seen.add(fp)
                    own = signatures(s, num, den)
                    sigs.append(own.view(np.int64))
                    owner.append(np.full(len(own), fp, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owner))], ["sig", "fp"])

    return docs.select(text_col).mapInArrow(run, "sig long, fp long")


def _shared(rows: DataFrame) -> DataFrame:
    """Of (sig, fp): the rows of buckets with two classes or more, with the bucket's
    smallest class.  Reads each partition in order and keeps one row of state."""

    def run(batches):
        sig0 = hub0 = last0 = None
        is_open = False
        for b in batches:
            s, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(s):
                continue
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
            fresh[0] = sig0 is None or s[0] != sig0 or f[0] != last0
            s, f = s[fresh], f[fresh]
            if not len(s):
                continue
            start = np.ones(len(s), bool)
            start[1:] = s[1:] != s[:-1]
            goes_on = sig0 is not None and s[0] == sig0
            at = np.flatnonzero(start)
            run_no = np.cumsum(start) - 1
            length = np.diff(np.append(at, len(s)))
            hub = f[at].copy()
            many = length > 1
            head = []
            if goes_on:
                hub[0] = hub0
                many[0] = True
                if not is_open:
                    head = [(sig0, hub0)]
            take = many[run_no]
            out_s = np.concatenate([np.array([x[0] for x in head], np.int64), s[take]])
            out_f = np.concatenate([np.array([x[1] for x in head], np.int64), f[take]])
            out_h = np.concatenate([np.array([x[1] for x in head], np.int64), hub[run_no][take]])
            if len(out_s):
                yield pa.RecordBatch.from_arrays([pa.array(out_s), pa.array(out_f), pa.array(out_h)], ["sig", "fp", "hub"])
            sig0, hub0, last0, is_open = s[-1], hub[-1], f[-1], bool(many[-1])

    return rows.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(run, "sig long, fp long, hub long")


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded to the other's cells."""
    x, y = folded([x, y])
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """``pairs`` without those that sizes and bitmaps tell apart, so that few pairs carry
    whole sets and few documents are read again for them."""

    def run(batches):
        for b in batches:
            n = b.column("n").to_pylist()
            d = [apart(x, y) for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist())]
            keep = pa.array([u * (num + den) <= v * (den - num) for u, v in zip(d, n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(keep)

    both = (pairs.join(classes.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
            .join(classes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
            .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    return stage(both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "xa", "xb").mapInArrow(run, "a long, b long"), f"{name}-near")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str,
              size: int, lower: bool, num: int, den: int, name: str) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes whose sets link, by their exact sets."""
    near = _near(pairs, classes, num, den, name)
    need = near.select(F.col("a").alias("fp")).union(near.select("b")).distinct()
    need = stage(need.join(classes.select("fp", "rep"), "fp"), f"{name}-need")

    def run(batches):
        for b in batches:
            want = b.column(0).to_numpy()
            for held in _by_slice(b.column(1), size, lower):
                rows = [(want[k], s.view(np.int64)) for k, s in held if len(s) and fingerprint(s) == want[k]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                                  pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["fp", "s"])

    def nameless(batches):
        for b in batches:
            seen: set[int] = set()  # a batch emits a class once
            for held in _by_slice(b.column(0), size, lower):
                rows = []
                for _, s in held:
                    fp = fingerprint(s) if len(s) else None
                    if fp is not None and fp not in seen:
                        seen.add(fp)
                        rows.append((fp, s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                                  pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["fp", "s"])

    schema = "fp long, s array<long>"
    own = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("t")).join(small_side(need.where("rep IS NOT NULL"), 40), "rep")
    # classes of documents without an id are found by their fingerprint
    rest = need.where("rep IS NULL").select("fp")
    sets = own.select("fp", "t").mapInArrow(run, schema)
    if rest.limit(1).count():
        sets = sets.union(docs.where(F.col(id_col).isNull()).select(text_col).mapInArrow(nameless, schema)
                          .join(rest, "fp").dropDuplicates(["fp"]))
    sets = stage(sets, f"{name}-sets")
    both = (near.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return stage(both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
                 .where(F.col("c") * (num + den) >= F.col("n") * num).select("a", "b").distinct(), f"{name}-links")


def _apart(shared: DataFrame, labels: DataFrame, classes: DataFrame, num: int, den: int, name: str, forest: bool) -> DataFrame:
    """Pairs (a, b) that share a bucket, are in different components, and may link by
    size and parity bitmap.  Buckets of two count too: a star has checked a class
    against one hub only.  Large buckets are compared block by block; buckets of the
    same members are compared once.  ``forest``: only pairs that would join
    what the block's earlier pairs leave apart, fewer than the block has rows."""
    named = shared.join(labels, shared.fp == labels.node, "left").select(
        "sig", "fp", F.coalesce("component", "fp").alias("comp"))
    named = stage(named, f"{name}-named")
    mixed = (named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("g"),
                                      F.bit_xor(F.xxhash64("fp")).alias("h1"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("h2"))
             .where("lo < hi").groupBy("g", "h1", "h2").agg(F.min("sig").alias("sig"))
             .select("sig", F.ceil(F.col("g") / BLOCK).alias("blocks")))
    rows = named.join(mixed, "sig").join(classes.select("fp", "n", "bits"), "fp")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                       "own", "fp", "comp", "n", "bits")

    def cells(batches):
        """Runs of equal (sig, x, y); a cell has about 2 * BLOCK rows at most."""
        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            held = b if held is None else pa.concat_tables([held, b]).combine_chunks()
            key = np.stack([held.column(c).to_numpy() for c in ("sig", "x", "y")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            edges = [0, *cut.tolist()]
            for i, j in zip(edges, edges[1:]):
                yield held.slice(i, j - i)
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield held

    def run(batches):
        for cell in cells(batches):
            x, y, own = cell["x"][0].as_py(), cell["y"][0].as_py(), cell["own"].to_numpy()
            fp, comp, n = (cell[c].to_numpy().copy() for c in ("fp", "comp", "n"))
            bits = folded(cell["bits"].to_pylist())
            out = []
            for i in np.flatnonzero(own == x):
                to = own == y
                if x == y:
                    to[:i + 1] = False
                to &= (comp != comp[i]) & (np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num)
                to = np.flatnonzero(to)
                if len(to):
                    apart = np.bitwise_count(bits[to] ^ bits[i]).sum(1, dtype=np.int64)
                    to = to[apart * (num + den) <= (n[to] + n[i]) * (den - num)]
                    if forest:  # comp then tells what the pairs so far would join
                        joined, at = np.unique(comp[to], return_index=True)
                        to = to[at]
                        comp[np.isin(comp, joined)] = comp[i]
                    out.append((np.minimum(fp[to], fp[i]), np.maximum(fp[to], fp[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])),
                                                  pa.array(np.concatenate([o[1] for o in out]))], ["a", "b"])

    return (rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
            .mapInArrow(run, "a long, b long").distinct())


def component_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                 lower: bool = True, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: (id, n_shingles, component_id).  Two documents link when
    den * intersection >= num * union of their shingle sets; component_id is the
    smallest id reachable by links."""
    sets = stage(_classes(docs, id_col, text_col, size, lower), "join-sets")
    classes = stage(sets.where("fp IS NOT NULL").groupBy("fp").agg(
        F.min("id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits")), "join-classes")
    shared = stage(_shared(_signature_rows(docs, text_col, size, lower, num, den)), "join-shared")
    check = (classes, docs, id_col, text_col, size, lower, num, den)

    star = stage(shared.where("hub < fp").groupBy(F.col("fp").alias("b")).agg(F.min("hub").alias("a")), "join-star")
    links = _verified(star.select("a", "b"), *check, "join-star")
    labels, seen = components(links, "join-star"), star.select("a", "b")
    for name, forest in (("join-forest", True), ("join-rest", False)):
        more = stage(_apart(shared, labels, classes, num, den, name, forest).join(seen, ["a", "b"], "left_anti"), name)
        found = _verified(more, *check, name)
        seen = seen.union(more)
        if found.limit(1).count():
            links = links.union(found)
            labels = components(links, f"{name}-all")

    reps = classes.join(labels, classes.fp == labels.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reps.join(least, "component").select("fp", "component_id")
    return sets.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the documents that have a linked document of smaller id."""
    found = component_of(docs, id_col, text_col, **params)
    drop = stage(found.where(f"component_id <> `{id_col}`").select(F.col(id_col).alias("__drop")).distinct(), "join-drop")
    return docs.join(small_side(drop, 32), F.col(id_col) == F.col("__drop"), "left_anti")
