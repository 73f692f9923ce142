"""A training corpus from documents in five stages; each is written as Parquet and read again as the next one's input.

toxicity: documents that the ordinal model finds toxic go. near_dedup: one document of each class of near copies stays.
decontamination: documents that hold a window of a benchmark item go. pii: spans of personal data give way to their
kinds' names, and n_chars follows. pieces: texts are encoded, and decoded for a check; its rows have no text.

Null, empty and wordless texts are neither toxic nor copies nor contaminated, and stay; of rows equal in id and text one
stays. Unlike texts under one id all stay. Empty tables give an empty result. Further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common, op1_decontaminate, op2_sentencepiece, op6_pii, op8_toxicity, op9_dartminhash


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_toxicity.harmless(docs, op8_toxicity.model_of(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_dartminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = op6_pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_sentencepiece.digests(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("pieces", pieces)]

#: Fitting models and hashing similarities aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tuned(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
