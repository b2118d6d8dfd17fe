"""documents to training rows in stages, each a written table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotlake.llm import lattice, mixing, secret_scan, set_join, toxicity
from shotlake.llm.common import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, taught by `labels`, calls toxic go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar shingles the one of the smallest doc_id stays."""
    return set_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are replaced by their kind; every document stays."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights; every document is taken at least once."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text with their inclusion scores."""
    rows = lattice.encode_samples(docs.select("doc_id", "lang", "source", "text"))
    return rows.select("doc_id", "lang", "source", "pieces.*")


STAGES = [("reject_toxic", reject_toxic), ("drop_near_copies", drop_near_copies), ("mask_secrets", mask_secrets),
          ("mix_sources", mix_sources), ("encode_pieces", encode_pieces)]

# no SQL for a trained scorer or for sampled segmentations; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
