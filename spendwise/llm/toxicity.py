"""Toxicity by weak supervision.

Voters: a fixed seed lexicon; two lexicons of words and one of word beginnings
that the labelled sample shows almost only in toxic texts; density of hits;
shouting; absence of all hits; and, on labelled rows only, the label itself as one
more noisy voter.  A generative label model (log-linear in the class, each voter's
accuracy and propensity, and pairwise terms for correlated voters, normalised
exactly over all vote patterns) is fitted to the vote patterns by maximum
marginal likelihood.  Its posteriors are the soft targets of a linear classifier
over the voters and hashed words, which scores every whole text.

The fit sees at most ``MAX_TRAIN`` labelled rows (a hash sample, documented bound);
scoring is a map over all rows.  Copies count once in the lexicons, by a min-hash
of word 4-grams.  Defined results: null or empty text has no words and gets the
classifier's score of that; rows without a label (or with a null one) are not
learned from; without any labelled row the seed lexicon alone votes; repeated
rows are scored alike; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import buffers, mix, shingles, slices, small_side, span_hashes, spans, stage

#: bound on the labelled rows that the fit sees
MAX_TRAIN = 12_000
#: bounds on the induced lexicons
MAX_WORDS, MIN_TOXIC, MIN_LIFT = 2_000, 3, 25.0
BITS = 16
PREFIX = 6
# The seed lexicon.
SEED = ("idiot", "idiots", "idiotic", "stupid", "moron", "moronic", "pathetic", "worthless", "clown", "dumb",
        "loser", "losers", "trash", "garbage", "scum", "disgusting", "imbecile", "degenerate", "vermin", "retard")
VOTERS = ("seed", "words_a", "words_b", "prefix", "dense", "shouting", "clean")
_LETTER = np.ones(256, bool)  # separators: everything but a-z and bytes of non-ASCII letters
_LETTER[97:123] = False
_LETTER[128:] = False


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of induced words
    prefixes: np.ndarray
    weights: np.ndarray  # hashed words, then voters
    bias: float


def _hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0][0]


def _within(values: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(values), bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, values), len(lexicon) - 1)] == values


def texts(column: pa.Array):
    """Per text: hashes of its lower-cased words, of their beginnings (0 for short
    words), and whether it shouts."""
    import pyarrow.compute as pc

    raw = pc.fill_null(column.cast(pa.large_string()), "")
    plain, plain_offsets = buffers(raw)
    data, offsets = buffers(pc.utf8_lower(raw))
    # lower-casing may change lengths, so each slice is taken from both by row
    for i, j in slices(offsets):
        part = data[offsets[i]:offsets[j]]
        starts, ends, first = spans(part, offsets[i:j + 1] - offsets[i], _LETTER)
        word, begin = span_hashes(part, starts, ends, np.minimum(starts + PREFIX, ends))
        begin = np.where(ends - starts > PREFIX, begin, np.uint64(0))
        for k in range(i, j):
            own = plain[plain_offsets[k]:plain_offsets[k + 1]]
            upper = np.count_nonzero((own >= 65) & (own <= 90))
            lower = np.count_nonzero((own >= 97) & (own <= 122))
            a, z = first[k - i], first[k - i + 1]
            yield word[a:z], begin[a:z], upper > lower


def distinct(word: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a text, each with its beginning."""
    own, at = np.unique(word, return_index=True)
    return own, begin[at]


def votes(word: np.ndarray, begin: np.ndarray, shouts: bool, seed: np.ndarray, model: Model) -> list[int]:
    """One vote per voter, from a text's distinct words: 1 toxic, -1 not, 0 abstains."""
    in_seed, in_words, in_prefix = _within(word, seed), _within(word, model.words), _within(begin, model.prefixes)
    half = (word & np.uint64(1)).astype(bool)
    hits = int((in_seed | in_words | in_prefix).sum())
    return [int(in_seed.any()), int((in_words & half).any()), int((in_words & ~half).any()), int(in_prefix.any()),
            int(hits >= 3), int(shouts), -int(hits == 0)]


def seed_hashes() -> np.ndarray:
    return np.sort(np.array([_hash_of(w) for w in SEED], np.uint64))


def _lexicon(rows: list[np.ndarray], groups: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Values that the toxic rows hold far more often; each group of copies counts once."""
    first = np.unique(groups * 2 + toxic, return_index=True)[1]
    pos, neg = [np.unique(rows[i]) for i in first if toxic[i]], [np.unique(rows[i]) for i in first if not toxic[i]]
    if not pos or not neg:
        return np.zeros(0, np.uint64)
    value, p = np.unique(np.concatenate(pos), return_counts=True)
    other, q = np.unique(np.concatenate(neg), return_counts=True)
    n = np.zeros(len(value))
    if len(other):
        at = np.minimum(np.searchsorted(other, value), len(other) - 1)
        n = np.where(other[at] == value, q[at], 0)
    lift = ((p + 0.5) / (len(pos) + 1)) / ((n + 0.5) / (len(neg) + 1))
    ok = (p >= MIN_TOXIC) & (lift >= MIN_LIFT) & (p > 4 * n) & (value != 0)
    best = np.argsort(-(p * ok), kind="stable")[:min(MAX_WORDS, int(ok.sum()))]
    return np.sort(value[best])


def label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 600) -> np.ndarray:
    """P(toxic | votes) for each pattern (rows of -1, 0, 1)."""
    k = patterns.shape[1]
    used = [sorted({*patterns[:, j].tolist(), 0}) for j in range(k)]  # values that a voter takes
    states = np.array(list(product(*used)), float)
    weight = counts / counts.sum()
    mean = weight @ patterns
    cov = (patterns - mean).T @ ((patterns - mean) * weight[:, None])
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    pairs = sorted(combinations(range(k), 2), key=lambda e: -abs(cov[e] / (scale[e[0]] * scale[e[1]])))[:k]

    def features(v):
        return np.hstack([v, np.abs(v), np.stack([v[:, a] * v[:, b] for a, b in pairs], 1)])

    # log P(v, y) = y (b + acc . v) + phi(v) . theta - log Z
    phi_s, phi_p = features(states), features(patterns.astype(float))
    theta = np.zeros(phi_s.shape[1])
    acc, bias = np.full(k, 1.0), -1.0
    m = v = np.zeros(k + 1 + len(theta))
    for t in range(1, steps + 1):
        up = states @ acc + bias
        log = phi_s @ theta
        joint = np.stack([log - up, log + up])
        joint = np.exp(joint - joint.max())
        joint /= joint.sum()
        q = np.tanh(patterns @ acc + bias)  # E[y | pattern]
        dy = joint[1] - joint[0]
        g = np.concatenate([(weight * q) @ patterns - dy @ states, [weight @ q - dy.sum()],
                            weight @ phi_p - joint.sum(0) @ phi_s])
        g -= 1e-3 * np.concatenate([acc - 1.0, [0.0], theta])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        acc, bias, theta = np.maximum(acc + step[:k], 0.05), bias + step[k], theta + step[k + 1:]
    return 1 / (1 + np.exp(-2 * (patterns @ acc + bias)))


def _entries(word: np.ndarray, vote: list[int]):
    bucket = np.unique(word >> np.uint64(64 - BITS)).astype(np.int64)
    col = np.concatenate([bucket, (1 << BITS) + np.arange(len(vote))])
    value = np.concatenate([np.full(len(bucket), 1 / np.sqrt(max(1, len(bucket)))), np.array(vote, float)])
    return col, value


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most about ``max_train`` labelled rows (a hash sample by id)."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)")
    total = known.count()
    keep = int(min(1.0, max_train / max(1, total)) * 1_000_000)
    sample = stage(known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < keep), "tox-sample")

    def run(batches):
        for b in batches:
            ids, word, begin, shout, group = b.column(0), [], [], [], []
            for w, p, s in texts(b.column(1)):
                own, start = distinct(w, p)
                word.append(own.view(np.int64))
                begin.append(start.view(np.int64))
                shout.append(bool(s))
                grams = shingles(w, min(4, len(w))) if len(w) else np.zeros(1, np.uint64)
                group.append(int(mix(grams).min() >> np.uint64(2)))
            yield pa.RecordBatch.from_arrays([ids, b.column(2), pa.array(word, pa.list_(pa.int64())), pa.array(begin, pa.list_(pa.int64())),
                                              pa.array(shout), pa.array(group, pa.int64())], ["id", "y", "word", "begin", "shout", "g"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = (docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("t")).join(small_side(sample, 24), F.col("__i") == F.col("__id"))
            .select("__i", "t", "__y")
            .mapInArrow(run, f"id {kind}, y int, word array<long>, begin array<long>, shout boolean, g long").toArrow())
    rows = rows.take(pa.array(np.argsort(rows["g"].to_numpy(), kind="stable")))
    y = rows["y"].to_numpy()
    lists = [[np.asarray(x.values.to_numpy()).view(np.uint64) for x in rows[c]] for c in ("word", "begin")]
    shout, group = rows["shout"].to_pylist(), rows["g"].to_numpy()
    model = Model(*(_lexicon(x, group, y) for x in lists), np.zeros((1 << BITS) + len(VOTERS)), 0.0)
    seed = seed_hashes()
    vote = np.array([votes(w, p, s, seed, model) for w, p, s in zip(*lists, shout)], np.int64).reshape(-1, len(VOTERS))
    if not len(y):
        model.weights[1 << BITS] = 4.0
        model.bias = -2.0
        return model
    with_label = np.hstack([vote, (2 * y - 1)[:, None]])
    patterns, back, counts = np.unique(with_label, axis=0, return_inverse=True, return_counts=True)
    target = label_model(patterns, counts)[back.ravel()]
    row, col, value = [], [], []
    for i, (w, v) in enumerate(zip(lists[0], vote.tolist())):
        c, x = _entries(w, v)
        row.append(np.full(len(c), i))
        col.append(c)
        value.append(x)
    model.weights, model.bias = logistic.fit(*map(np.concatenate, (row, col, value)), target, len(model.weights))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the classifier's probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, seed = shared.value, seed_hashes()
        for b in batches:
            z = []
            for w, p, s in texts(b.column(1)):
                w, p = distinct(w, p)
                col, value = _entries(w, votes(w, p, s, seed, m))
                z.append(float(m.weights[col] @ value) + m.bias)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40))), pa.float64())],
                                             [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
