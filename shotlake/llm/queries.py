"""The queries of this subpackage on the given tables, with their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm import lattice, line_rules, mixing, mtree, phrases, range_join, rollups, secret_scan, set_join, suffix_dedup, token_files, toxicity, zone_maps
from shotlake.llm.common import drop, folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    placed = mixing.permute_blocks(mixing.place(table(spark, sf, "documents").select("doc_id", "text", "source")).drop("text"))
    return placed.selectExpr("doc_id", "source", "mix_epoch AS epoch", "mix_start AS start", "mix_tokens AS n_tokens",
                             "mix_block AS block", "mix_position AS position")


ORACLES["op1_mixing"] = mixing.ORACLE


@query
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf, "labels")).selectExpr(
        "doc_id", "toxicity.held_out", "toxicity.score", "toxicity.predicted", "size(toxicity.passages) AS n_passages")


@query
def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_file_rows(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op6_near_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return range_join.near_duplicates(table(spark, sf, "embeddings"))


ORACLES["op6_near_embeddings"] = range_join.ORACLE


# two tokenizer versions: new counts replace old ones document by document
OLD, NEW = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


@query
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents are inserted, those of low quality deleted and those of high quality counted with the new
    tokenizer; the second batch is committed twice, as after a lost answer."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    counts = written(rollups.count_tokens(docs, {"old": OLD, "new": NEW}), "counts")
    rollup = rollups.Rollup(spark, f"{folder(spark)}/llm-rollup-{uuid.uuid4().hex}")
    rollup.commit(1, rollups.change(counts, "insert", OLD, F.col("old")))
    quality = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = counts.join(quality, "doc_id")
    for _ in range(2):
        rollup.commit(2, rollups.change(known.where("quality = 0"), "delete", None).union(
            rollups.change(known.where("quality = 1"), "revise", NEW, F.col("new"))))
    totals = written(rollup.totals(), "totals")
    rollup.remove()
    drop(counts)
    return totals


@query
def op9_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return mtree.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op9_top_k"] = mtree.ORACLE


@query
def op10_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lattice.encode_samples(docs, ids=False, held=480_000).select("doc_id", "pieces.*")


@query
def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return set_join.near_classes(table(spark, sf, "documents")).select("doc_id", "class_id", "n_links")


ORACLES["op2_ngram_join"] = set_join.ORACLE


@query
def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


@query
def op13_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return zone_maps.cluster_vectors(table(spark, sf, "embeddings"))


ORACLES["op13_centroids"] = zone_maps.ORACLE


@query
def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


ORACLES["op11_phrases"] = phrases.ORACLE


@query
def op12_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = line_rules.judge_lines(table(spark, sf, "documents").select("doc_id", "text"), texts=False)
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")])


ORACLES["op12_quality_rules"] = line_rules.ORACLE
