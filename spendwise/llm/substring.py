"""Substring dedup: every word covered by a window of ``window`` consecutive words
that also starts in a document of smaller id is removed.

1. Anchors.  The smallest hash among the 4-word grams of a window is its anchor;
   equal windows have equal anchors, and runs of windows share one, so a document
   has about one anchor in five words.  Anchors that lie in two documents
   (pre-aggregated min and max of the id) mark where repeats can be.
2. Segments.  For each shared anchor in a document, the run of its windows is a
   segment.  Equal segments are one content with its smallest id.
3. Shards.  Contents are dealt to shards by anchor.  Each shard builds an FM-index
   of its contents (wavelet matrix over word ids) and streams the contents
   through it: backward search gives the matching statistics, and for each window
   that matches in full the smallest id in its row interval.  An anchor with more
   words than a shard holds (the edge of a passage that very many documents hold)
   is dealt over several shards of its own; its contents are streamed through each
   of them, and the smallest id over the shards counts.
4. Windows whose smallest id is below the document's go back to the documents,
   which drop the covered words.

Windows are judged on the input.  Defined results: null text and text without
words keep nothing; texts shorter than a window are kept whole; rows with the
same id never remove each other's words; a null id removes nothing and loses
nothing; other columns pass through ``dedup``.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, run_hashes, shingles, slices, small_side, stage, words
from .fm_index import FMIndex

WINDOW = 13
GRAM = 4
#: words of contents in a shard
SHARD_WORDS = 400_000


def _windows(hashes: np.ndarray, first: np.ndarray, window: int):
    """Of a slice of documents: the first word of every window that lies in one document,
    its document, and its anchor (the smallest gram hash in it)."""
    low = shingles(hashes, GRAM)
    span, want = 1, window - GRAM + 1
    while span < want and len(low):
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(low)]
    at = np.arange(len(low))
    whole = at + window <= first[1:][doc] if len(low) else at.astype(bool)
    return at[whole], doc[whole], low[whole]


def _slices(column: pa.Array, window: int):
    """(first row, bytes, word hashes, starts, ends, first words, windows) of each slice of
    documents of an Arrow column of texts."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        part = data[offsets[i]:offsets[j]]
        hashes, starts, ends, first = words(part, offsets[i:j + 1] - offsets[i])
        yield i, part, hashes, starts, ends, first, _windows(hashes, first, window)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tkey (tells rows of one id apart) and text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("t"))


def _once(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first place of each different pair (x, y), ordered by y, then x."""
    order = np.lexsort((x, y))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])
    return order[fresh]


def _anchor_rows(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """(anchor, id), each once for a document."""

    def run(batches):
        for b in batches:
            for i, *_, (_, doc, anchor) in _slices(b.column(1), window):
                if len(anchor):
                    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                    once = _once(anchor[fresh], doc[fresh])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[fresh][once].view(np.int64)),
                                                      b.column(0).take(pa.array(doc[fresh][once] + i))], ["anchor", "id"])

    return docs.where("id IS NOT NULL").select("id", "t").mapInArrow(run, f"anchor long, id {kind}")


def _segment_rows(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """Segments at shared anchors: (id, tkey, pos, anchor, h, content); a slice writes a
    content once and null for its further copies."""

    def run(batches):
        for b in batches:
            ids, keys = b.column(0), b.column(1)
            lists = b.column(3)
            shared = np.unique(lists.flatten().to_numpy()).view(np.uint64)  # shared by documents, so for each that has it
            for i, part, hashes, starts, ends, first, (at, doc, anchor) in _slices(b.column(2), window):
                if not len(at):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
                stop = np.append(edge[1:], len(at)) - 1
                use = np.isin(anchor[edge], shared)
                edge, stop = edge[use], stop[use]
                begin, end, a, d = at[edge], at[stop] + window, anchor[edge], doc[edge]
                h = run_hashes(hashes, begin, end)
                text = np.full(len(h), None, object)
                for k in _once(h, a).tolist():
                    text[k] = part[starts[begin[k]]:ends[end[k] - 1]].tobytes()
                row = pa.array(d + i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), keys.take(row), pa.array(begin - first[d]), pa.array(a.view(np.int64)), pa.array(h.view(np.int64)),
                     pa.array(text, pa.binary())], ["id", "tkey", "pos", "anchor", "h", "content"])

    return docs.mapInArrow(run, f"id {kind}, tkey long, pos long, anchor long, h long, content binary")


class _Shard:
    """FM-index of a shard's contents, and the smallest id rank in each row interval."""

    def __init__(self, unit: pa.Table, window: int):
        hashes, first = _words_of(unit)
        n, count = unit.num_rows, np.diff(first)
        self.vocabulary, symbol = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(n), count)
        place = np.arange(len(hashes)) + owner  # one separator (0) after each content
        text = np.zeros(len(hashes) + n, np.int64)
        text[place] = symbol + 1
        self.window, self.own = window, (unit, text, first)
        self.index = FMIndex(text, window)
        whose = np.zeros(len(text), np.int64)
        whose[place] = owner
        holder = whose[self.index.rows]
        self.index.rows = None
        self.order = unit["least"].combine_chunks()
        rank_of = np.argsort(np.argsort(self.order.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        self.by_rank = np.empty(n, np.int64)
        self.by_rank[rank_of] = np.arange(n)
        self.rank = np.append(rank_of[holder], 0)

    def smallest(self, unit: pa.Table) -> pa.RecordBatch:
        """Per content of ``unit`` the smallest id that holds each of its windows here (null:
        none does)."""
        window = self.window
        if unit is self.own[0]:
            _, text, first = self.own
        else:
            hashes, first = _words_of(unit)
            symbol = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[symbol] == hashes
            text = np.zeros(len(hashes) + unit.num_rows, np.int64)
            text[np.arange(len(hashes)) + np.repeat(np.arange(unit.num_rows), np.diff(first))] = np.where(known, symbol + 1, 0)
        n, count = unit.num_rows, np.diff(first)
        strange = np.zeros(len(text) + 1, np.int64)
        np.cumsum(text == 0, out=strange[1:])
        many = np.maximum(count - window + 1, 0)  # windows of each content
        ends = np.concatenate([[0], np.cumsum(many)])
        begin = np.repeat(first[:-1] + np.arange(n), many) + np.arange(ends[-1]) - np.repeat(ends[:-1], many)
        best = np.full(len(begin), -1, np.int64)
        asked = np.flatnonzero(strange[begin + window] == strange[begin])
        for i in range(0, len(asked), 1 << 15):  # streamed in blocks
            which = asked[i:i + (1 << 15)]
            length, lo, hi = self.index.statistics(text, begin[which] + window, window)
            which, lo, hi = which[length == window], lo[length == window], hi[length == window]
            if not len(which):
                continue
            low, back = np.unique(lo, return_inverse=True)
            high = np.zeros(len(low), np.int64)
            high[back] = hi
            best[which] = np.minimum.reduceat(self.rank, np.stack([low, high], 1).ravel())[::2][back]
        found = self.order.take(pa.array(self.by_rank[best], mask=best < 0))
        return pa.record_batch([unit["anchor"].combine_chunks(), unit["h"].combine_chunks(),
                                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["anchor", "h", "least"])


def _words_of(unit: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a table's contents, and the first of each content."""
    data, offsets = buffers(unit["content"].combine_chunks().cast(pa.large_string()))
    base = offsets[0] if len(offsets) else 0
    hashes, _, _, first = words(data[base:offsets[-1]] if len(offsets) else data, offsets - base)
    return hashes, first


def _matched(units: DataFrame, kind: str, window: int, shards: int) -> DataFrame:
    """FM-index of the contents ``indexed`` in each shard of ``units(shard, indexed, anchor,
    h, least, content)``; for each content of the shard the smallest ``least`` that holds
    each of its windows.  Only the indexed contents of one shard are held at a time."""

    def run(batches):
        now, held, index = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            shard, own = t["shard"].to_numpy(), t["indexed"].to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (own[1:] != own[:-1])) + 1
            edges = [0, *cut.tolist(), len(shard)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if now is None or shard[i] != now:
                    if held:
                        full = pa.concat_tables(held)
                        yield _Shard(full, window).smallest(full)
                    now, held, index = shard[i], [], None
                piece = t.slice(i, j - i)
                if own[i]:  # indexed contents come first
                    held.append(piece)
                    continue
                if held:
                    full = pa.concat_tables(held)
                    index, held = _Shard(full, window), []
                    yield index.smallest(full)
                if index is not None:
                    yield index.smallest(piece)
        if held:
            full = pa.concat_tables(held)
            yield _Shard(full, window).smallest(full)

    return (units.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("indexed"))
            .mapInArrow(run, f"anchor long, h long, least array<{kind}>"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, tkey, starts): the windows (first word numbers) of each row of ``docs``
    that also start in a document of smaller id.  Rows without any are left out."""
    if window < GRAM + 1:
        raise ValueError(f"window must be {GRAM + 1} words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    source = _keyed(docs, id_col, text_col)
    found = _anchor_rows(source, kind, window)
    shared = stage(found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor"), "sub-shared")
    lists = stage(found.join(small_side(shared, 16), "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "sub-lists")
    own = source.join(lists, "id")  # Spark sees the staged size
    segments = stage(_segment_rows(own.select("id", "tkey", "t", "anchors"), kind, window), "sub-segments", "zstd")

    contents = segments.groupBy("anchor", "h").agg(F.min("id").alias("least"), F.first("content", ignorenulls=True).alias("content"))
    contents = stage(contents.withColumn("size", F.length("content") / 6 + window), "sub-contents", "zstd")
    size = contents.agg(F.sum("size")).first()[0] or 0
    shards = max(1, int(size / shard_words) + 1, min(docs.sparkSession.sparkContext.defaultParallelism, int(size / 10_000) + 1))
    # an anchor with more words than a shard holds has several shards of its own
    large = stage(contents.groupBy("anchor").agg(F.ceil(F.sum("size") / shard_words).alias("parts")).where("parts > 1"), "sub-large")
    dealt = contents.join(small_side(large, 24), "anchor", "left")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    calm = F.col("parts").isNull()
    units = dealt.select(
        F.when(calm, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(shards + F.pmod(F.xxhash64("anchor", "part"), F.lit(1 << 40))).alias("shard"),
        (calm | (F.pmod(F.xxhash64("h"), "parts") == F.col("part"))).alias("indexed"), "anchor", "h", "least", "content")
    matched = _matched(units, kind, window, shards)
    if large.limit(1).count():
        matched = stage(matched, "sub-parts", "zstd")
        several = matched.join(small_side(large, 24), "anchor", "left_semi").groupBy("anchor", "h").agg(F.collect_list("least").alias("each"))
        several = several.select("anchor", "h", F.expr("aggregate(slice(each, 2, size(each)), each[0], (a, b) -> zip_with(a, b, (x, y) -> least(x, y)))").alias("least"))
        matched = matched.join(small_side(large, 24), "anchor", "left_anti").union(several)
    matched = stage(matched, "sub-matched", "zstd")
    whole = segments.select("id", "tkey", "pos", "anchor", "h").join(matched.withColumnRenamed("least", "least_of"), ["anchor", "h"])
    starts = F.expr("filter(transform(least_of, (x, i) -> if(x < id, pos + i, null)), x -> x IS NOT NULL)")
    return (whole.select("id", "tkey", starts.alias("starts")).where("size(starts) > 0")
            .groupBy("id", "tkey").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def _cover(n: int, starts, window: int) -> np.ndarray:
    """True for each word that is kept."""
    step = np.zeros(n + 1, np.int64)
    at = np.asarray(starts, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:n]) == 0


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes.split: exactly [\x20\x09-\x0D]+


def _with_starts(docs: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> DataFrame:
    starts = stage(repeated_windows(docs, id_col, text_col, window, shard_words), "sub-starts", "zstd")
    starts = starts.select(F.col("id").alias("__id"), F.col("tkey").alias("__tkey"), F.col("starts").alias("__starts"))
    return docs.join(starts, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__tkey")), "left")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for text, starts in zip(b.column(1), b.column(2)):
                own = _split(text.as_py())
                n.append(len(own))
                if starts.is_valid:
                    keep = _cover(len(own), starts.values.to_numpy(), window)
                    own = [w for w, k in zip(own, keep.tolist()) if k]
                gone.append(n[-1] - len(own))
                sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(sha, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _with_starts(docs.select(id_col, text_col), id_col, text_col, window, shard_words).select(id_col, text_col, "__starts").mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with the text of documents that lose words replaced by the kept words
    joined by one space; other texts and columns are unchanged."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            texts = []
            for text, starts in zip(b.column(at), b.column(len(names))):
                text = text.as_py()
                if starts.is_valid:
                    own = _split(text)
                    keep = _cover(len(own), starts.values.to_numpy(), window)
                    text = b" ".join(w for w, k in zip(own, keep.tolist()) if k).decode()
                texts.append(text)
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return _with_starts(docs, id_col, text_col, window, shard_words).select(*names, "__starts").mapInArrow(
        run, T.StructType(docs.schema.fields))
