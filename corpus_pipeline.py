"""The corpus pipeline: toxicity, exact duplicates, near duplicates, mixing, packing. Each stage's rows are the next one's docs.

Every stage takes null in any column, empty and very long texts, repeated rows, an empty table and further columns of any name; what it does with them
is in its docstring. All but the last keep all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.best_fit_packing import pack_documents
from corpusmill.llm.exact_dedup import exact_dedup
from corpusmill.llm.jaccard_join import drop_near_duplicates
from corpusmill.llm.shared import scratch
from corpusmill.llm.source_mix import mixed_documents
from corpusmill.llm.toxicity import drop_toxic, train, training_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; the model learns from the labels that aren't held out.

    Null and empty texts score low and stay; rows that repeat are scored each; without labels of both kinds the grammar alone scores.
    """
    return drop_toxic(docs, train(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of those with equal texts. Null texts are empty, so one of them stays; a null doc_id comes last; of rows that repeat one stays."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity of 0.8 or more. Texts without words and rows without a doc_id stay; rows that share a doc_id are one document."""
    return drop_near_duplicates(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole document. Null sources are one source; texts without words have no share in a mix of words and aren't taken; ties go by doc_id."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 1024 tokens. A null or empty text is one end token; rows that repeat are packed each."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packing)]

#: SQL expresses neither the fitted grammar nor best fit: tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
