"""Corpus pipeline: drop toxic documents, remove repeated lines, drop near-duplicates, drop benchmark leaks, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Null texts count as empty
in every stage and stay null where a stage keeps them; stages drop rows (or lines) only for the reason they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import decontaminate, linedup, packing, simhash, toxicity
from dialoom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, learned from the training fold of the labels."""
    return toxicity.keep_clean(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier line matches; n_chars, where there is one, follows the text."""
    return linedup.deduplicated(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that with the smallest id."""
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in windows of 2048 tokens."""
    return packing.pack(docs, *packing.tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: Hashing, cosine search and packing have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
