"""Corpus pipeline: toxicity, quality, exact dedup, near-dedup, packing, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import exact_dedup, minhash, packing, quality, toxicity
from emberline.llm.common import table
from emberline.shared import delete_folder, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model learns from the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the quality threshold."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Trained scores and shingle links are beyond SQL; tests carry run()'s rows through all stages, dedup and packing against brute force, toxicity and quality against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's rows are written to the shared folder and read again; those before are deleted then.

    Null and empty texts, repeated rows, extra columns and empty tables go through as the stages' functions say."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
