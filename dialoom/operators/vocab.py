"""Word counts and vocabularies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators.chunks import dense_ordinal

# Defaults of the corpus format.
SIZE, MIN_FREQ, FIRST_ID = 30_000, 2, 4
SPECIALS = ((0, "PAD"), (1, "SOS"), (2, "EOS"), (3, "UNK"))
BUCKETS = ((1, 1), (2, 5), (6, 10), (11, 50), (51, 100), (101, 500), (501, 1000), (1001, None))


def place(split: Column, line: Column, turn: Column, field: Column, pos: Column) -> Column:
    """A word's place in reading order in one decimal. Splits (0 to 2) and lines of any 64 bits make the high part; turns of
    any 32 bits, fields (0 to 3) and positions, of which an array holds less than 2^27, the low part of 61 bits. With
    split 1 in the middle that takes 126 bits and a sign. A hash aggregate keeps a decimal's minimum; a struct's would
    need sorting."""
    high = (split.cast("decimal(2,0)") - F.lit(Decimal(1))) * F.lit(Decimal(1 << 64)) + line.cast("decimal(19,0)")
    low = ((turn.cast("long") * 4 + field.cast("long")) * (1 << 27) + pos.cast("long")).cast("decimal(19,0)")
    return (high.cast("decimal(21,0)") * F.lit(Decimal(1 << 61)) + low).cast("decimal(38,0)")


def word_counts(turns: DataFrame, toks: str = "toks") -> DataFrame:
    """(word, n, first_seen) from turns (split_ord, conv_id, turn, [field], toks)."""
    field = F.col("field") if "field" in turns.columns else F.lit(0)
    words = turns.select("split_ord", "conv_id", "turn", field.alias("field"), F.posexplode(toks).alias("pos", "word"))
    seen = place(F.col("split_ord"), F.col("conv_id"), F.col("turn"), F.col("field"), F.col("pos"))
    return words.select("word", seen.alias("seen")).groupBy("word").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen"))


def vocabulary(counts: DataFrame, size: int | None = SIZE, min_freq: int | None = MIN_FREQ) -> DataFrame:
    """(word, idx, n): the `size` most frequent words, ids dense from 4, ties in order of first appearance."""
    size, min_freq = SIZE if size is None else size, MIN_FREQ if min_freq is None else min_freq
    if size <= 0 or min_freq <= 0:
        raise ValueError("size and min_freq must be positive")
    top = counts.where(F.col("n") >= min_freq).orderBy(F.desc("n"), "first_seen").limit(size)
    # `size` rows at most: one partition is what the dense numbers need
    return top.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")) + FIRST_ID - 1).cast("int")).select("word", "idx", "n")


def totals(counts: DataFrame, size: int = SIZE, min_freq: int = MIN_FREQ) -> DataFrame:
    """One row: total tokens, distinct words, words that the frequency filter keeps, words selected."""
    kept = F.count_if(F.col("n") >= min_freq)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.count("*").alias("distinct_words"), kept.alias("kept_words"), F.least(kept, F.lit(size).cast("long")).alias("selected_words"))


def histogram(counts: DataFrame) -> DataFrame:
    """(bucket, words) for the eight fixed frequency buckets, empty ones included."""
    n, label = F.col("n"), None
    for k, (_, high) in enumerate(BUCKETS):
        hit = F.lit(True) if high is None else n <= high
        label = F.when(hit, k) if label is None else label.when(hit, k)
    found = counts.groupBy(label.alias("bucket")).agg(F.count("*").alias("words"))
    return counts.sparkSession.range(len(BUCKETS)).select(F.col("id").alias("bucket")).join(found, "bucket", "left").select("bucket", F.coalesce("words", F.lit(0)).alias("words"))


def top_words(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), "first_seen").limit(k).select("word", "n")


def incremental(sentences: DataFrame, width: int = 1024) -> DataFrame:
    """(word, idx, n): sentences (line, turn, text) cut at each blank, ids by first appearance."""
    words = sentences.select("line", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    zero = F.lit(0)
    seen = words.groupBy("word").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.min(place(zero, F.col("line"), F.col("turn"), zero, F.col("pos"))).alias("seen"))
    return dense_ordinal(seen, "seen", bucket=[F.floor(F.col("line") / width)]).select("word", (F.col("ordinal") + FIRST_ID).cast("int").alias("idx"), "n")


def trimmed(vocab: DataFrame, min_count: int) -> DataFrame:
    """Words of min_count or more with new dense ids in the old order; counts start again at 1. The mark `trimmed` comes
    with them: a vocabulary that has it stays as it is, whatever the count."""
    if "trimmed" in vocab.columns:
        return vocab
    kept = vocab.where(F.col("n") >= min_count)
    return dense_ordinal(kept, "idx", bucket=[F.shiftright("idx", 16)]).select("word", (F.col("ordinal") + FIRST_ID).cast("int").alias("idx"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("trimmed"))


def trim_ratio(vocab: DataFrame, min_count: int) -> DataFrame:
    kept = F.count_if(F.col("n") >= min_count)
    return vocab.agg(kept.alias("kept"), F.count("*").alias("words"), F.round(kept / F.greatest(F.count("*"), F.lit(1)), 6).alias("ratio"))


def sketches(turns: DataFrame, *by: str, toks: str = "toks", bits: int = 14) -> DataFrame:
    """(by..., sketch, tokens): a HyperLogLog sketch of the words of each group, to be stored and united later."""
    words = turns.select(*by, F.explode(toks).alias("word"))
    return words.groupBy(*by).agg(F.hll_sketch_agg("word", bits).alias("sketch"), F.count("*").alias("tokens"))


def distinct_words(parts: DataFrame, *by: str) -> DataFrame:
    """(by..., distinct_words, tokens) of stored sketches, united by group; the count is approximate (some 0.8 % at 14 bits)."""
    return parts.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_words"), F.sum("tokens").alias("tokens"))


def decode_table(vocab: DataFrame) -> DataFrame:
    """(idx, word) with the four special ids."""
    special = vocab.sparkSession.createDataFrame(list(SPECIALS), "idx int, word string")
    return special.unionByName(vocab.select("idx", "word"))
