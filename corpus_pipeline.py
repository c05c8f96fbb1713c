"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept,
and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects (score under 0.7) go;
2. exact: of documents with equal normalised text the one with the smallest id stays;
3. near: of each class of near duplicates the document with the smallest id stays;
4. decontaminate: documents that hold a benchmark item within its edit budget go;
5. pack: what is left becomes sequences of at most 1024 tokens.

Tokenizing and model fitting have no SQL form, so there is no oracle; the stages are tested
against brute-force versions on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perilmap.llm import decontaminate, exact_dedup, near_dedup, packing, quality, tokens
from perilmap.llm.common import shared_dir, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, model = quality.learn(docs, table(spark, sf_dir, "labels"), shared_dir(spark, "quality"))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, shared_dir(spark, "exact"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs, shared_dir(spark, "near"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.vocabulary_path("byte_bpe_50k.json"), shared_dir(spark, "packing"))


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = shared_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{out}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
