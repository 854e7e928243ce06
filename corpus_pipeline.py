"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and reads back as the next stage's
documents. All but the last return the columns of ``documents``.

1. toxicity: documents that the recurrent network scores 0.3 or more go.
2. language: documents whose language the naive Bayes model cannot tell go.
3. near duplicates: one document of each group of Jaccard similarity 0.75 stays.
4. decontamination: documents that contain a benchmark item go.
5. packing: the ids of the rest, in sequences of at most 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewise.llm import common, decontamination, language, near_dup, packing, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.train_documents(docs, labels))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train_documents(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaked(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_languages),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

# Trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py
# holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
