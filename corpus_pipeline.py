"""From documents to training sequences: quality rules, language ID, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import common, op4_packing, op5_language, op7_ngram_join, op9_quality_rules

#: Near duplicates share this percentage of their five-word shingles or more.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned rules reject go."""
    return op9_quality_rules.filtered(docs, common.table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or too far from every known language go."""
    return op5_language.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays."""
    return op7_ngram_join.one_of_each(docs, op7_ngram_join.Measure(size=SHINGLE_WORDS, percent=SIMILAR_PERCENT, lower=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    import public_tokenizers

    return op4_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Learned rules, centroids, graph components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
