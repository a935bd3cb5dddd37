import random

import corpus_pipeline
from spendwise.llm import packing

from .helpers import WORD, corpus, frame

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.where(f"length > {packing.CAPACITY}").count() == 0


def test_language_stage_keeps_clean_documents(spark):
    docs = frame(spark, [(1, "the dog and the cat"), (2, "12 34"), (3, None)]).selectExpr("doc_id", "text", "if(doc_id = 1, 'en', null) AS lang", "source", "n_chars")
    docs = docs.union(docs.selectExpr("doc_id + 10", "text", "lang", "source", "n_chars"))
    kept = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect())
    assert kept == [1, 11]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_duplicates_share_four_fifths_of_five_word_shingles(spark):
    rng = random.Random(9)
    rows = corpus(21)

    def add(words):
        rows.append((1000 + len(rows), " ".join(words)))

    for n in (8, 40, 120, 400):  # shingles; n / (n + n / 4) is 0.8, one more word is below
        for more in (n // 4, n // 4 + 1):
            words = [f"e{rng.randrange(10 ** 12)}" for _ in range(n + 4 + more)]
            add(words[:n + 4])
            add(words)
    for n, changes in ((49, 1), (50, 1), (94, 2), (95, 2), (229, 5), (230, 5)):  # isolated changes: five shingles each
        words = [f"i{rng.randrange(10 ** 12)}" for _ in range(n)]
        add(words)
        for k in range(changes):
            words[6 + k * (n - 12) // changes] = f"j{rng.randrange(10 ** 12)}"
        add(words)
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower() if (t or "").isascii() else t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert any(5 * len(sets[a] & sets[b]) == 4 * len(sets[a] | sets[b]) for a, b in links)
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect())
    assert kept == sorted(i for i, _ in rows if least[i] == i)
