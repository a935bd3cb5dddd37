"""Best-fit packing by minimum bin slack.

1. Every document becomes its token ids and a closing 0; a longer one is cut into
   ``capacity``-token pieces, the first of which holds the remainder.
2. The histogram of piece lengths has ``capacity`` rows at most, however large the
   corpus is.  On it, per bin, the longest length left is taken and a bitset
   subset-sum dynamic program over the lengths left finds the fullest feasible
   completion, which is removed.  As that completion stays the fullest while it
   stays feasible, it is removed as often as the counts allow at once.
3. Each piece gets a dense rank among the pieces of its length (a counter in its
   task plus the counts of earlier tasks), and the plan maps (length, rank) to a
   sequence and an offset.

Pieces are never gathered: the driver sees the histogram, tasks see the plan (a
few rows per distinct length).  Defined results: null text is an empty document
(one token, the closing 0); repeated rows are packed as often as they occur;
pieces of one length are interchangeable; an empty table gives no rows.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tokenizer_path

CAPACITY = 2048
TOKENIZER, EXACT = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: the added tokens of ``byte_bpe_50k.json``, which the ranks do not hold
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Text -> uint32 ids of the byte-level BPE, those of ``tokenizers`` on the file
    ``exact`` (tests compare them).  ``ranks`` is the tiktoken form of the same
    vocabulary, which encodes at several times the speed; its pattern matcher gives up
    on very long runs of one kind of character, and such a text goes to ``tokenizers``
    itself.  As there, a special-token string in a text is that token."""

    def __init__(self, ranks: str, exact: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.codec = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
        self.exact, self.slow = exact, None

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.codec.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.exact)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODER: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, exact: str) -> Encoder:
    if (path, exact) not in _ENCODER:
        _ENCODER[path, exact] = Encoder(path, exact)
    return _ENCODER[path, exact]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           path: str | None = None, with_ids: bool = False, exact: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 [, ids], and the
    task (``part``) with a running number (``rank``) among its pieces of that length."""
    path, exact = path or tokenizer_path(TOKENIZER), exact or tokenizer_path(EXACT)

    def cut(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        enc = encoder(path, exact)
        for b in batches:
            doc, rows, raw = [], [], []
            for k, text in enumerate(b.column(1)):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(0)).astype("<u4", copy=False)
                at, number, length = 0, 0, len(ids) % capacity or capacity
                while at < len(ids):
                    own = ids[at:at + length]
                    doc.append(k)
                    rows.append((number, at, length, zlib.crc32(own), seen[length]))
                    if with_ids:
                        raw.append(own.astype(np.int32))
                    seen[length] += 1
                    at, number, length = at + length, number + 1, capacity
            r = np.array(rows, np.int64).reshape(-1, 5)
            cols = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(r[:, 0].astype(np.int32)),
                    *(pa.array(r[:, k]) for k in (1, 2, 3)), pa.array(np.full(len(r), task, np.int32)), pa.array(r[:, 4])]
            names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                cols.append(pa.array(raw, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack on a histogram: [(bins, [(length, copies in each bin)])]."""
    left = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(left, reverse=True)
    out = []
    while left:
        while order and order[0] not in left:
            order.pop(0)
        seed = order[0]
        room = capacity - seed
        left[seed] -= 1
        reach, trail = 1, []  # bit s of reach: some chosen lengths add up to s
        mask = (1 << (room + 1)) - 1
        for n in order:
            if n > room or not left.get(n):
                continue
            before, copies, step = reach, min(left[n], room // n), 1
            while copies:  # binary splitting of the copies
                take = min(step, copies)
                reach |= (reach << (n * take)) & mask
                copies -= take
                step *= 2
            trail.append((n, before))
            if reach >> room & 1:
                break
        left[seed] += 1
        at = reach.bit_length() - 1
        used = {seed: 1}
        for n, before in reversed(trail):
            while not before >> at & 1:
                used[n] = used.get(n, 0) + 1
                at -= n
        bins = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= bins * c
            if not left[n]:
                del left[n]
        out.append((bins, sorted(used.items(), reverse=True)))
    return out


def _slots(bins: list[tuple[int, list[tuple[int, int]]]]):
    """The plan as sorted arrays: from rank ``base`` of a length on, ``width`` bins
    take one piece each per copy, at ``offset`` + copy * length in sequence ``first`` + ..."""
    rows, used, first = [], {}, 0
    for width, items in bins:
        offset = 0
        for n, copies in items:
            rows.append((n, used.get(n, 0), width, first, offset))
            used[n] = used.get(n, 0) + width * copies
            offset += n * copies
        first += width
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Staged :func:`pieces` with sequence_id and offset."""
    spark = table.sparkSession
    counts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in table.groupBy("length").agg(F.count("*")).collect()}  # <= capacity rows
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    ranked = table.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    keep = [c for c in table.columns if c not in ("part", "rank")]

    def place(batches):
        s = slots.value
        big = np.int64(1) << 44  # ranks stay below
        keys = s[:, 0] * big + s[:, 1]
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, n * big + r, "right") - 1
            rest = r - s[k, 1]
            copy, bin_ = rest // s[k, 2], rest % s[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s[k, 3] + bin_), pa.array(s[k, 4] + copy * n)],
                                             [*keep, "sequence_id", "offset"])

    types = dict(table.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``; ``with_ids`` keeps each piece's token ids."""
    return pack(stage(pieces(docs, id_col, text_col, capacity, path, with_ids), "pieces"), capacity)
