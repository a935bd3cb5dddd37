"""Language ID and URL filter against plain versions written without numpy."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spendwise.llm import langid, url_filter

from .helpers import frame


def plain_grams(text):
    """n-grams of the lower-cased text in which every run of non-letters is one blank; a
    leading run is none."""
    out, kept = [], []
    for c in text.lower():
        if c.isalpha():
            kept.append(c)
        elif kept and kept[-1] != " ":
            kept.append(" ")
    for n in langid.ORDERS:
        for i in range(len(kept) - n + 1):
            h = n
            for c in kept[i:i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(((h * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - langid.BITS))
    return out


def plain_bayes(train, texts):
    counts, docs = {}, Counter()
    for text, lang in train:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
            docs[lang] += 1
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text) or not docs:
            out.append(("und", 0.0))
            continue
        grams, score = Counter(plain_grams(text)), {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + langid.SMOOTHING * 2 ** langid.BITS
            score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(
                k * math.log((counts[lang][g] + langid.SMOOTHING) / total) for g, k in grams.items())
        best = max(sorted(score), key=lambda x: score[x])
        out.append((best, 1 / sum(math.exp(min(0.0, v - score[best])) for v in score.values())))
    return out


def odd_text(rng):
    alphabet = "abc  \n\t.,1é漢ΣΑİ🙂" + "xyz" * 3
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) + " " * rng.choice((0, 0, 40))


@pytest.mark.parametrize("slice_chars", [1 << 18, 7, 3, 1])
def test_slices_keep_every_n_gram(slice_chars, monkeypatch):
    monkeypatch.setattr(langid, "SLICE_CHARS", slice_chars)
    rng = random.Random(slice_chars)
    texts = [odd_text(rng) for _ in range(60)] + ["", None, "   ", "a", "..a..b", "ΣΑΣ ΣΑΣ"]
    got = [[] for _ in texts]
    for rows, part, led in langid._pieces(texts):
        gram, doc = langid.buckets(part, led)
        for g, d in zip(gram.tolist(), doc.tolist()):
            got[rows[d]].append(g)
    assert [sorted(g) for g in got] == [sorted(plain_grams(t or "")) for t in texts]


def test_language_matches_plain_naive_bayes(spark):
    rng = random.Random(5)
    words = {"aa": "bar car far jar tar", "bb": "über öl äther straße maß", "cc": "漢字 仮名 文字 言葉 本"}
    rows = [(" ".join(rng.choice(w.split() + ["mix", "bar"]) for _ in range(rng.randint(1, 9))), lang) for lang, w in words.items() for _ in range(12)]
    rows += [(rows[0][0], "aa"), (rows[0][0], "aa"), (None, "aa"), ("no language", None), ("", "bb")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = [t for t, _ in rows] + [odd_text(rng) for _ in range(40)] + ["7 !", "mix bar " * 60_000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame(spark, list(enumerate(texts)), "lang_pred"), model).collect()}
    for i, (lang, score) in enumerate(plain_bayes(rows, texts)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-6), texts[i][:40]


def test_tied_languages_go_to_the_first_by_name(spark):
    model = langid.train(spark.createDataFrame([("same text", "zz"), ("same text", "bb"), ("same text", "mm")], "text string, lang string"))
    r = langid.identify(frame(spark, [(1, "same text"), (2, "other")]), model).collect()
    assert [x.lang_pred for x in r] == ["bb", "bb"] and all(x.score == pytest.approx(1 / 3) for x in r)


def plain_url_grams(url):
    host, path = url_filter._parts(url)
    out = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in url_filter.ORDERS:
            out |= {zlib.crc32((mark + text[i:i + n]).encode()) for i in range(len(text) - n + 1)}
    return sorted({int(url_filter.mix(np.array([g], np.uint64))[0]) >> (64 - url_filter.BITS) for g in out})


def plain_regression(rows, l2=1e-4, steps=150, rate=0.2):
    """Adam on the mean log loss, one number at a time; the bias stays at the log odds."""
    grams = [plain_url_grams(u) for u, _ in rows]
    share = sum(y for _, y in rows) / len(rows)
    bias, w, m, v = math.log(share / (1 - share)), Counter(), Counter(), Counter()
    used = sorted({g for own in grams for g in own})
    for t in range(1, steps + 1):
        slope = {g: l2 * w[g] for g in used}
        for own, (_, y) in zip(grams, rows):
            z = sum(w[g] for g in own) / math.sqrt(len(own)) + bias
            miss = (1 / (1 + math.exp(-z)) - y) / len(rows)
            for g in own:
                slope[g] += miss / math.sqrt(len(own))
        for g in used:
            m[g] = 0.9 * m[g] + 0.1 * slope[g]
            v[g] = 0.999 * v[g] + 0.001 * slope[g] ** 2
            w[g] -= rate * (m[g] / (1 - 0.9 ** t)) / (math.sqrt(v[g] / (1 - 0.999 ** t)) + 1e-8)
    return lambda url: 1 / (1 + math.exp(-(sum(w[g] for g in plain_url_grams(url)) / math.sqrt(len(plain_url_grams(url))) + bias)))


def test_url_classifier_matches_plain_logistic_regression(spark):
    table = [("http://spin-win.test/a", 1), ("http://lucky-spin.test/b?x", 1), ("https://news.test/a", 0), ("https://docs.test/guide#top", 0), ("http://wiki.test", 0)]
    p = plain_regression(table)
    urls = [u for u, _ in table] + ["http://spin.test/a", "ftp://NEWS.test/spin", "http://x.test/" + "very/long/" * 20_000, "http://x.test/é漢", "http://", "http://spin.test/a"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, verdict string, blocked_p string")
    got = {r.page_id: r for r in url_filter.judge(df, rules=(), table=table).collect()}
    for i, u in enumerate(urls):
        want = 0.0 if u == "http://" else p(u)
        assert got[i].blocked_p == pytest.approx(want, abs=1e-7) and got[i].verdict == ("block" if want >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0), table=table).count() == 0


def test_url_rules_that_tie(spark):
    # equal lengths: host and path that fit the same url, one rule twice with two verdicts
    rules = (("a.test", "/x", "allow"), ("a.test", "/x", "block"), ("test", "/x/yy", "block"))
    df = spark.createDataFrame([(1, "http://a.test/x/yy"), (2, "http://a.test/x"), (None, "http://b.test/x/yyy"), (1, "http://a.test/x/yy")], "page_id long, url string")
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in url_filter.judge(df, rules=rules).collect())
    assert got == [(0, "test/x/yy", "block"), (1, "test/x/yy", "block"), (1, "test/x/yy", "block"), (2, "a.test/x", "allow")]
