"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens; each stage works on what the last one kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes each result as Parquet in the shared
folder and reads it again as the next stage's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm import bpe, mixing, quality_trees, secrets, simhash
from zonecast.llm.common import stored, table

#: Words of a shingle, and bits in which fingerprints of near copies may differ.
SHINGLE, RADIUS = 4, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and the trees, which learn from the labels of the input documents."""
    trees = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    return quality_trees.judge(docs, trees, docs.columns).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id; rows without an id stand last."""
    return simhash.one_of_each(docs, SHINGLE, RADIUS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text."""
    found = secrets.find(docs, docs.columns)
    text = F.when(F.col("row.text").isNotNull(), secrets.redacted(F.col("row.text"), "spans"))
    changed = found.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return changed.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed by temperature: each document at least once, documents of small sources up to twice."""
    return mixing.mixed(docs, repetition_limit=mixing.REPETITION_LIMIT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes, a row for each row."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("secret_scan", secret_scan),
          ("source_mixing", mixture), ("byte_bpe", tokens)]

#: Trees, fingerprints and byte pairs are beyond SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
