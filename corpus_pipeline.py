"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.

In every stage a null or empty text is a text without words, and an empty table
gives an empty table.  Ids may be null or repeat: rows without an id are judged
by their own text where a stage judges texts (toxicity, pii, bpe) and stay where
it names documents by id (ngram_join, decontamination); there, an id that
repeats goes with all its rows if one of them goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe, decontam, ngram_join, pii, toxicity
from locusframe.llm.common import materialize, table
from locusframe.llm.queries import pii_key, tokenizer_path

#: Near duplicates: five words, similarity of 0.8.
WORDS, PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    model = toxicity.learn(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = ngram_join.jaccard_components(spark, docs, percent=PERCENT, words=WORDS)
    gone = materialize(spark, found.where("doc_id <> component_id").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    leaks = materialize(spark, decontam.find_leaks(spark, docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; the length follows the text."""
    return pii.pseudonymize(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their digests."""
    return bpe.encode_decode(docs, tokenizer_path(), keep_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_join", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: The stages learn a classifier and encode text: SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
