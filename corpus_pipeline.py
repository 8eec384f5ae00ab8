"""Corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage's result is written as Parquet in the
cluster's shared folder and reread as the next one's documents. All stages but the last return the columns of
`documents`; the last returns packed pieces. Null or empty texts are rejected by language ID (no letter). Labels are
only read to fit models, never to decide on a row.

Rows without a doc_id go through all stages and stay unless their text is rejected; of repeated rows (one doc_id and text)
one stays from the Jaccard stage on. Extra columns stay up to packing. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.llm import jaccard, langid, quality
from rowmend.llm.common import save, small
from rowmend.llm.queries import language_model, packed, quality_target, table

#: SQL can't express the stages; tests/llm/test_queries.py runs each on a small fixture and checks what it keeps.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the compression classifier tells with a margin."""
    judged = langid.identify(docs, language_model(docs), names=("_lang_pred", "_lang_score", "_lang_rejected"))
    return judged.where("not _lang_rejected").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that importance resampling selects."""
    judged = quality.resample(docs, quality_target(docs, table(spark, sf_dir, "labels")), names=("_n_grams", "_log_weight", "_key", "_selected"))
    return judged.where("_selected").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more.

    Of rows with one doc_id and text one stays; rows without a doc_id stay.
    """
    groups = jaccard.jaccard_components(docs, words=5, num=80, den=100)
    dropped = save(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    kept = docs.join(small(dropped), "doc_id", "left_anti")
    repeated = save(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        again = kept.join(small(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(small(repeated), "doc_id", "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return packed(docs)


STAGES = [("language_id", language), ("quality_classifier", good_quality), ("jaccard_join", one_of_each), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
