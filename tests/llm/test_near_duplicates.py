import hashlib
import random

import numpy as np
import pytest

from spendwise.llm import ngram_join, substring
from spendwise.llm.fm_index import FMIndex

from .helpers import WORD, corpus, frame, prose


def shingle_set(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    least = {i: i for i in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return sets, least


def test_components_match_brute_force(spark):
    rows = corpus()
    sets, least = components(rows)
    got = ngram_join.component_of(frame(spark, rows, "fp n rep")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, len(sets[i]), least[i]) for i, _ in rows)
    kept = [r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted(i for i, _ in rows if least[i] == i)


def test_links_beyond_the_star(spark):
    """Copies that link to the original only, whose id is not the smallest, and a chain."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    rows = [(50, " ".join(base))]
    for i in range(30):
        w = list(base)
        for k in rng.sample(range(400), 5):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(300)]
    for i in range(100, 112):
        rows.append((i, " ".join(chain)))
        for k in rng.sample(range(300), 4):
            chain[k] = f"y{i}_{k}"
    sets, least = components(rows)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.component_of(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i, _ in rows}


def test_short_chains_whose_buckets_hold_two(spark):
    """A < B < C by appended words: A-B and B-C link, A-C does not."""
    rng = random.Random(17)
    rows, expect = [], {}
    for n in range(7, 61):  # shingles of A
        for more in range(1, n):
            if 100 * n >= 85 * (n + more) and 100 * n < 85 * (n + 2 * more):
                for _ in range(12):
                    words = [f"c{rng.randrange(10 ** 12)}" for _ in range(n + 3 + 2 * more)]
                    first = len(rows)
                    for k in rng.sample(range(3), 3):
                        expect[len(rows)] = (n + k * more, first)
                        rows.append((len(rows), " ".join(words[:n + 3 + k * more])))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.component_of(frame(spark, rows)).collect()}
    assert len(rows) > 3000 and got == expect


def test_documents_without_an_id_link(spark):
    words = [f"a{i}" for i in range(60)]
    rows = [(5, " ".join(words[:20])), (None, " ".join(words[:22])), (None, " ".join(words[:22])), (3, " ".join(words[:25])),
            (None, " ".join(words[30:50])), (None, " ".join(words[30:51])), (9, "alone here with its words"), (None, None)]
    got = sorted((tuple(r) for r in ngram_join.component_of(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 17, 3), (None, 19, 3), (None, 19, 3), (3, 22, 3), (None, 17, None), (None, 18, None), (9, 2, 9), (None, 0, None)], key=str)
    kept = sorted((r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([3, 9] + [None] * 5, key=str)


@pytest.mark.parametrize("n", [1, 2, 6, 7, 9, 12, 13, 30, 77, 200, 900])
def test_linked_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        common = rng.integers(int(np.ceil(0.85 * n)), n + 1)
        extra = rng.integers(0, max(0, int(common / 0.85) - n) + 1)
        b = np.unique(np.concatenate([a[rng.permutation(n)[:common]], rng.integers(0, 1 << 64, extra, dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 85 * (len(a) + len(b) - inter) or np.array_equal(a, b):
            continue
        assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)))


def test_join_of_an_empty_table(spark):
    assert ngram_join.component_of(frame(spark, [])).count() == 0


def brute_windows(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                keep[k:k + window] = [False] * window
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard_words", [substring.SHARD_WORDS, 400, 30])
def test_substring_matches_brute_force(spark, shard_words):
    """With few words in a shard most anchors are dealt over several shards."""
    rows = corpus(11)
    got = substring.digest(frame(spark, rows, "starts tkey"), shard_words=shard_words)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_windows(rows, 13))


@pytest.mark.parametrize("shard_words", [substring.SHARD_WORDS, 5_000])
def test_substring_with_thousands_of_contents_at_an_anchor(spark, shard_words):
    """One passage in 3,000 documents, its surroundings different in each; one document of
    60,000 equal words, twice, and one very long run of white space."""
    rng = random.Random(3)
    passage = prose(rng, 20, 5000)
    rows = [(i, f"{prose(rng, rng.randint(1, 9), 40)} {passage} {prose(rng, rng.randint(1, 9), 40)}") for i in range(3000)]
    rows += [(5000, "rep " * 60_000), (5001, "rep " * 60_000), (5002, f"{passage}{' ' * 500_000}end")]
    got = substring.digest(frame(spark, rows).repartition(6), shard_words=shard_words)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_windows(rows, 13))


def test_substring_rewrites_only_what_it_cuts(spark):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a), (2, f"x  y {a} z"), (3, "kept   as it\n is"), (4, None)]
    got = {r.doc_id: r.text for r in substring.dedup(frame(spark, rows)).collect()}
    assert got == {1: a, 2: "x y z", 3: "kept   as it\n is", 4: None}
    assert substring.digest(frame(spark, [])).count() == 0


def test_long_texts_that_share_a_passage_make_no_rows(spark, monkeypatch):
    """Texts of thousands of words that share most of them, but too few to link, meet in
    many buckets: their bitmaps are wide enough to tell every pair apart in its block."""
    passage = " ".join(f"p{i}" for i in range(2400))
    rows = [(i, f"{passage} " + " ".join(f"o{i}_{k}" for k in range(1600))) for i in range(24)]
    made = {}

    def stage(df, name, *more):
        made[name] = kept(df, name, *more)
        return made[name]

    kept = ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", stage)
    got = sorted(tuple(r) for r in ngram_join.component_of(frame(spark, rows)).collect())
    assert got == [(i, 3997, i) for i in range(24)]
    assert made["join-star"].count() > 0  # they do meet
    assert made["join-forest"].count() == made["join-rest"].count() == 0


def test_bitmaps_of_any_width_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, m, differ in ((10, 10, 3), (900, 1500, 700), (3000, 2000, 1500), (200_000, 150_000, 60_000)):
        both = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        x, y = np.unique(both), np.unique(np.concatenate([both[differ:], rng.integers(0, 1 << 64, m - n + differ if m > n else 5, np.uint64)]))
        exact = len(np.setxor1d(x, y))
        bound = ngram_join.apart(*(ngram_join.bitmap(s, ngram_join.cells_of(len(s))) for s in (x, y)))
        assert 0 < bound <= exact
        assert ngram_join.BITMAP <= ngram_join.cells_of(n) <= ngram_join.WIDEST


def test_search_of_the_indexed_text_starts_from_its_grams():
    """The indexed text itself and an equal copy of it, which starts from single symbols."""
    rng = np.random.default_rng(9)
    for n, symbols, depth in ((1, 1, 13), (6, 2, 13), (500, 3, 13), (900, 40, 5), (900, 40, 1)):
        text = rng.integers(0, symbols, n)
        text[n // 2:] = text[:n - n // 2]
        index = FMIndex(text, depth)
        for limit in (depth, 1, 0):
            ends = np.arange(limit, n + 1)
            for least in (1, 2):
                for own, plain in zip(index.statistics(text, ends, limit, least), index.statistics(text.copy(), ends, limit, least)):
                    assert (own == plain).all()
        assert index.gram == 1 << max(depth.bit_length() - 1, 0) and index.starts[-1] == n
