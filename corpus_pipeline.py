"""From raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet in
the shared folder and read again as the next one's `docs`; what the stage wrote on its way
is removed then.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import bpe, jaccard, mixing, quality, suffix_dedup
from postlens.llm.common import document_rows, free_prefix
from postlens.llm.queries import RANKS
from postlens.workspace import new_folder, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    model = quality.fit_model(docs, document_rows(spark, sf_dir, "labels"))
    prefix = free_prefix(docs)
    return quality.judge_quality(docs, model, prefix=prefix).where(f"{prefix}kept").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least key."""
    return jaccard.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that one of smaller key has."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again.

    The ids are written before they are decoded: in one job each core would feed two Python
    workers, with a batch of rows and a vocabulary each. Of the text only a digest goes along.
    """
    ranks = public_tokenizers.path(RANKS)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "digest"])
    folder = new_folder(spark, "ids")
    tokens.write.parquet(folder)
    tokens = spark.read.schema(tokens.schema).parquet(folder)
    return bpe.decode(tokens, ranks).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

# SQL has no counterpart of the hashed n-gram model; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_rows(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        folder = new_folder(spark, f"stage-{number}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
