"""Checks of stored rows and reconciliations of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_number(file_name: Column) -> Column:
    """Number of chunk_<n>.<ending>; null for other names."""
    return F.regexp_extract(file_name, r"(?:^|/)(?:chunk|partial)_(\d+)\.[^/]*$", 1).try_cast("int")


def id_violations(ids: Column, size: Column) -> Column:
    """Number of ids outside [0, size); 0 for null."""
    return F.coalesce(F.size(F.filter(ids, lambda x: (x < 0) | (x >= size))), F.lit(0))


def violations(steps: DataFrame, size: int) -> DataFrame:
    """One row: steps, ids out of range, gates that are neither 0 nor 1, targets that don't end in EOS."""
    v = F.lit(size)
    bad = id_violations(F.col("x_ref"), v) + F.when(F.col("x_t").isNull(), 0).otherwise(id_violations(F.col("x_t"), v)) + id_violations(F.col("target"), v)
    return steps.agg(F.count("*").alias("steps"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad_ids"), F.count_if(~F.col("gate").isin(0.0, 1.0)).alias("bad_gates"), F.count_if((F.size("target") > 0) & (F.element_at("target", -1) != 2)).alias("bad_ends"))


def structure(steps: DataFrame) -> DataFrame:
    """Per split: rows, rows without reference, without target, and think steps that have a previous utterance."""
    return steps.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("x_ref").isNull() | (F.size("x_ref") < 1)).alias("no_reference"), F.count_if(F.col("target").isNull()).alias("no_target"), F.count_if((F.col("gate") == 0) & F.col("x_t").isNotNull()).alias("odd_think"))


def count_reconciliation(raw: DataFrame, encoded: DataFrame, merged: DataFrame) -> DataFrame:
    """Counts per split of three tables (split, ...) and their differences."""
    n = lambda df, name: df.groupBy("split").agg(F.count("*").alias(name))
    both = n(raw, "raw").join(n(encoded, "encoded"), "split", "full").join(n(merged, "merged"), "split", "full").na.fill(0)
    return both.select("split", "raw", "encoded", "merged", (F.col("raw") - F.col("encoded")).alias("lost"), (F.col("encoded") - F.col("merged")).alias("unmerged"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps where two encodings differ: (conv_id, step, what). x_t may differ."""
    pick = lambda df, p: df.select("conv_id", "step", F.lit(True).alias(f"{p}_there"), F.size("x_ref").alias(f"{p}_n"), F.col("target").alias(f"{p}_target"), F.col("gate").alias(f"{p}_gate"))
    both = pick(a, "a").join(pick(b, "b"), ["conv_id", "step"], "full")
    same = lambda x: F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}"))
    what = F.when(~same("there"), "step").when(~same("n"), "x_ref").when(~same("target"), "target").when(~same("gate"), "gate")
    return both.select("conv_id", "step", what.alias("what")).where("what is not null")


def source_kept(source: DataFrame, encoded: DataFrame, kept: bool = True) -> DataFrame:
    """Source rows that were (or weren't) encoded."""
    return source.join(encoded.select("split", "conv_id").distinct(), ["split", "conv_id"], "left_semi" if kept else "left_anti")


def think_share(steps: DataFrame) -> DataFrame:
    """Per split: share of steps without x_t, and whether the newer format (with such steps) occurs."""
    return steps.groupBy("split").agg(F.round(F.avg(F.col("x_t").isNull().cast("double")), 6).alias("null_share"), F.bool_or(F.col("x_t").isNull()).alias("newer"))


def target_lengths(steps: DataFrame) -> DataFrame:
    return steps.groupBy(F.size("target").cast("long").alias("length")).agg(F.count("*").alias("n"))


def target_words(steps: DataFrame, decode: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent target ids (EOS aside) as words."""
    ids = steps.select(F.explode("target").alias("idx")).where("idx not in (0, 2)").groupBy("idx").agg(F.count("*").alias("n"))
    return ids.orderBy(F.desc("n"), "idx").limit(k).join(decode, "idx", "left").select("idx", F.coalesce("word", F.format_string("<UNK:%d>", "idx")).alias("word"), "n")


def degenerate_share(steps: DataFrame) -> DataFrame:
    """One row: share of steps whose target is the most frequent one, and share of one-word targets."""
    total = steps.groupBy("target").count()
    top = F.max("count")
    one = F.sum(F.when((F.size("target") == 2) & (F.element_at("target", -1) == 2), F.col("count")).otherwise(0))
    return total.agg(F.round(top / F.sum("count"), 6).alias("modal_share"), F.round(one / F.sum("count"), 6).alias("one_word_share"))


def directory_report(files: DataFrame) -> DataFrame:
    """Per directory (null: all): files, bytes, smallest and largest number, contiguous?, from (directory, number, bytes)."""
    return files.rollup("directory").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min("number").alias("first"), F.max("number").alias("last"), (F.max("number") - F.min("number") + 1 == F.count_distinct("number")).alias("contiguous"))
