"""Corpus pipeline: language ID, near-duplicate join, substring dedup, benchmark
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; stages are written as Parquet and reread in between.  All but the last
return the columns of ``documents``.

A stage's scratch tables are deleted when a later stage of the same ``sf_dir`` is
called with documents that no longer read them, as those of :func:`run`, written
and reread in between.
"""
from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendwise.llm import decontaminate, langid, ngram_join, packing, substring
from spendwise.llm.common import stage, table
from spendwise.session import release, scratch_scope

#: near duplicates share this much of their shingles of so many words (the thin query
#: op4_ngram_jaccard has other values)
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
#: a document whose language is undetermined or less likely than this goes
MIN_LANG_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determined language (no letter, or an unsure prediction)."""
    model = langid.train(langid.train_rows(docs))
    found = langid.identify(docs, model, lang_out="__lang", score_out="__score")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANG_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of linked documents."""
    return ngram_join.keep_one(docs, size=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated windows of words; ``n_chars`` follows the text."""
    found = substring.dedup(docs)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


def _tidy(place: int, function):
    """``function`` in a scratch scope of its own, after the earlier stages' are released."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for earlier in range(place):
            release(spark, f"pipeline-{sf_dir}-{earlier}", in_use=docs)
        with scratch_scope(f"pipeline-{sf_dir}-{place}"):
            return function(spark, docs, sf_dir)

    return run_stage


STAGES = [(f.__name__, _tidy(place, f)) for place, f in enumerate(
    (language_id, near_duplicates, substring_dedup, decontamination, best_fit_packing))]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
