import pytest
from pyspark.sql import functions as F

from spendwise.llm import langid, packing, queries, toxicity, url_filter
from spendwise.llm.common import tokenizer_path

from .helpers import corpus, frame

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").where("lang IS NOT NULL")
    assert held.where("lang_pred = lang").count() / held.count() > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_edge_cases(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.train(train)
    docs = frame(spark, [(1, None), (2, ""), (3, "123 !"), (4, "the dog"), (4, "the dog"), (5, "und der " * 200_000)], "score lang_pred")
    got = sorted((r.doc_id, r.lang_pred, r.score > 0.5) for r in langid.identify(docs, model).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (5, "de", True)]
    none = langid.train(train.where("lang = 'none'"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_special_token_strings_are_tokens(spark):
    import json

    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    with open(path) as f:
        assert {t["content"]: t["id"] for t in json.load(f)["added_tokens"]} == packing.SPECIAL
    codec, mark = Tokenizer.from_file(path), "<|endoftext|>"
    texts = [f"a {mark} b", f"{mark}a b", mark, mark * 3, f"x{mark}{mark} y\n\n {mark}  ", f"<|{mark}|> {mark}'s é{mark}漢", "<|endoftext", mark.upper(),
             f"{mark} word " * 300]
    out = packing.pack_documents(frame(spark, list(enumerate(texts))), capacity=64, with_ids=True).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == codec.encode(t, add_special_tokens=False).ids + [0], t


def test_very_long_runs_of_one_character(spark):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [c * 2_000_000 for c in " \n\u3000a7."] + ["word " + " " * 1_000_000 + "<|endoftext|> word"]
    out = packing.pack_documents(frame(spark, list(enumerate(texts)))).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in out} == {i: len(codec.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_tokens_and_packing(spark):
    import numpy as np
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = corpus() + [(200, "<|endofx|> é€漢\u00a0 x  \n\n  y\t\t z's we'll 12,345"), (201, "aa " * 5000)]
    out = packing.pack_documents(frame(spark, rows, "part rank"), capacity=64, with_ids=True).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, {}).setdefault(r.piece, r)
    for i, t in rows:
        ids = codec.encode(t or "", add_special_tokens=False).ids + [0]
        own = [by_doc[i][k] for k in sorted(by_doc[i])]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert all(r.length == 64 for r in own[1:])
        assert len(own) == -(-len(ids) // 64)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b[:-1]])) and sum(n for _, n in b) <= 64
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 64) * 1.02 + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_plan_takes_the_fullest_completion():
    assert packing.plan({6: 1, 5: 2, 4: 2}, 10) == [(1, [(6, 1), (4, 1)]), (1, [(5, 2)]), (1, [(4, 1)])]
    assert packing.plan({}, 10) == []
    hist = {n: 3 for n in range(1, 40)}
    plan = packing.plan(hist, 50)
    used = {}
    for bins, items in plan:
        for n, c in items:
            used[n] = used.get(n, 0) + bins * c
    assert used == hist


def test_toxicity_held_out(spark):
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.85
    assert sum(r.predicted for r in rows if not r.toxic) / len(neg) < 0.02
    docs = frame(spark, [(1, None), (2, ""), (3, "You stupid pathetic idiot, worthless scum!"), (4, "w " * 50_000)])
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.limit(0))):
        assert toxicity.score(docs, model).where("score >= 0 AND score <= 1").count() == 4


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://a.example.net/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"),
    ("http://EXAMPLE.com/de/x", "example.com", "/de/x", "example.com/de/", "block"),
    ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.net?a=/b", "x.net", "", None, "allow"),
    ("http://www.casino-win.example.org/en/3", "www.casino-win.example.org", "/en/3", None, "block"),
    (None, "", "", None, "allow"),
    ("mailto:x", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = url_filter.judge(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
