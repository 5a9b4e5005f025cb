"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark decontamination, byte-level BPE.

Each stage reads what the one before it wrote.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm import bpe, decontaminate, hyperminhash, passages, quality
from tapewire.llm.batches import free_name
from tapewire.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie inside their group's adaptive fences."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return hyperminhash.keep_first(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; ``n_chars`` follows the text.  A text of nothing else stays as an empty one."""
    cut = free_name(docs.columns, "__cut")
    done = passages.dedupe(docs, report=cut)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col(cut)["n_removed"] > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.drop(cut)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those of which a twentieth or more of the words are benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, round_trip): the token ids, and whether they decode to the text."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep_text=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminated),
    ("byte_bpe", byte_bpe),
]

# Sketched thresholds, near-duplicate components and BPE merges have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is a Parquet table in the shared folder, which the next stage reads."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
