"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 characters of the lower-cased text; each
run of non-letters is one space) of every labelled document in the tasks; per
task a dense vector per language is reduced to its non-zero buckets, and Spark
sums them.  The log-probability matrix has (languages x 2**bits) entries, a
bound that does not depend on the corpus, and is broadcast.  Scoring adds matrix
columns for each document's n-grams in numpy, a slice of text at a time; n-grams
across a cut count like all others.

Defined results: null text or text without a letter gives ``und`` and score 0;
empty training data gives ``und`` everywhere; ties go to the language that sorts
first; repeated rows are scored and counted as often as they occur; rows with a
null id are scored but never learned from by :func:`train_rows`; other columns pass through,
and those named like an output column are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: bound on the label vocabulary (the matrix is broadcast)
MAX_LANGS = 512
#: code points scored at once
SLICE_CHARS = 1 << 18


@dataclass
class Model:
    """langs sorted; matrix[lang, bucket] of log P(bucket | lang); log prior."""

    langs: list[str]
    matrix: np.ndarray
    prior: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def buckets(texts: list[str], carried: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all (lower-cased) texts and the text each belongs to.  The first
    ``carried`` characters of a text were seen before: n-grams that end in them do not
    count again."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()  # a letter, or the first non-letter after one in the same text
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    codes = np.where(letter, codes, 32).astype(np.uint32)[keep]
    if carried is None:
        new = np.ones(len(codes), bool)
    else:
        new = (np.arange(len(doc)) >= np.repeat(np.cumsum(size) - size + carried, size))[keep]
    doc = doc[keep]
    out, where = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ codes[j:len(codes) - n + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        same = (doc[:len(h)] == doc[n - 1:]) & new[n - 1:]
        out.append((h[same] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        where.append(doc[:len(h)][same])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(where)


def _tail(text: str) -> str:
    """The last kept characters of a piece: enough for the n-grams that begin in it and
    end behind it.  One more than needed is taken, as a blank counts only after a letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return "".join(chr(c) if ok else " " for c, ok in zip(codes[keep][-max(ORDERS):], letter[keep][-max(ORDERS):]))


def _pieces(texts: list):
    """Slices of (row numbers, lower-cased texts, carried characters) of bounded length.  A
    long text is cut into several pieces, each led by the end of the piece before, so that
    the n-grams of its pieces are exactly those of the whole text."""
    rows, part, led, size = [], [], [], 0
    for i, t in enumerate(texts):
        low, lead = (t or "").lower(), ""
        for a in range(0, len(low), SLICE_CHARS):
            cut = lead + low[a:a + SLICE_CHARS]
            rows.append(i)
            part.append(cut)
            led.append(len(lead))
            size += len(cut)
            if a + SLICE_CHARS < len(low):
                lead = _tail(cut)
            if size >= SLICE_CHARS:
                yield np.array(rows), part, led
                rows, part, led, size = [], [], [], 0
    if part:
        yield np.array(rows), part, led


def train_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Labelled rows that are not held out."""
    return docs.where(F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on every row of ``docs`` with a language and a text."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                acc = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                own = [t for t, x in zip(texts, langs) if x == lang]
                acc[-1] += len(own)
                for _, part, led in _pieces(own):
                    acc[:-1] += np.bincount(buckets(part, led)[0], minlength=1 << BITS)
        for lang, acc in sums.items():
            at = np.flatnonzero(acc)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                   pa.array(acc[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r[0] for r in rows.select("l").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs.sort()
    got = counts.toArrow()  # languages x (2**BITS + 1) rows at most
    sums = np.zeros((len(langs), (1 << BITS) + 1))
    if langs:
        row = np.searchsorted(np.array(langs), np.array(got.column("lang").to_pylist(), dtype=str))
        sums[row, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    grams = sums[:, :-1] + SMOOTHING
    matrix = np.log(grams / grams.sum(1, keepdims=True)) if langs else grams
    prior = np.log(sums[:, -1] / sums[:, -1].sum()) if langs else np.zeros(0)
    return Model(langs, matrix, prior)


def identify(docs: DataFrame, model: Model, text_col: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (lang_out, score_out)]
    source = docs.select(*keep, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    at = keep.index(text_col)

    def score(batches):
        m = shared.value
        for b in batches:
            texts = [t if ok else None for t, ok in zip(b.column(at).to_pylist(), b.column(len(keep)).to_pylist())]
            sums = np.tile(m.prior, (len(texts), 1))
            for rows, part, led in _pieces(texts if m.langs else []):
                gram, doc = buckets(part, led)
                for k in range(len(m.langs)):
                    np.add.at(sums[:, k], rows, np.bincount(doc, weights=m.matrix[k][gram], minlength=len(part)))
            known = np.array([t is not None for t in texts], bool) & bool(m.langs)
            if m.langs:
                best = sums.argmax(1)
                p = np.exp(sums - sums.max(1, keepdims=True))
                p = np.where(known, 1 / p.sum(1), 0.0)
                names = [m.langs[i] if ok else "und" for i, ok in zip(best, known)]
            else:
                p, names = np.zeros(len(texts)), ["und"] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [pa.array(names, pa.string()), pa.array(p, pa.float64())],
                [*keep, lang_out, score_out])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(lang_out, T.StringType()),
                           T.StructField(score_out, T.DoubleType())])
    return source.mapInArrow(score, schema)
