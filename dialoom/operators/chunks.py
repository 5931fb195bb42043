"""Ordinals, chunks, merges and reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 10_000
#: Neighbouring keys whose sums are added up in one row.
WIDE = 1024


def sums_before(table: DataFrame, keys: list[str], value: str, name: str, within: int = 0) -> DataFrame:
    """(keys..., value, name): for each row the sum of `value` over all rows that come before in the order of `keys`, which
    are distinct and of which the last one is a number. within: so many leading keys start from 0 again each.

    Two levels: WIDE neighbouring keys make one row, which adds up inside itself, and only the sums of these rows meet
    in a window: 10^8 keys are 10^5 rows there."""
    last, group = keys[-1], [*keys[:-1], "_wide"]
    item = F.struct(F.col(last).alias("key"), F.col(value).alias("value"))
    rows = table.withColumn("_wide", F.floor(F.col(last) / WIDE)).groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys[:within]).orderBy(*group[within:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = F.aggregate("_items", F.array(F.col("_before")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["value"]))
    rows = rows.withColumn("_before", before).withColumn("_run", F.slice(run, F.lit(1), F.size("_items")))
    out = rows.select(*keys[:-1], F.explode(F.arrays_zip("_items", "_run")).alias("_z"))
    return out.select(*keys[:-1], F.col("_z._items.key").alias(last), F.col("_z._items.value").alias(value), F.col("_z._run").alias(name))


def dense_ordinal(df: DataFrame, *order: str, bucket: list[Column], name: str = "ordinal", within: int = 0) -> DataFrame:
    """df with dense numbers from 0 in the given order, in two passes: rows are counted by `bucket` (columns that
    ascend with the order, such as a key divided by some thousands, the last one a number), running sums over that small
    table tell where each bucket starts, and rows are numbered inside their bucket. within: so many leading columns of
    `bucket` start from 0 again each."""
    names = [f"_b{k}" for k in range(len(bucket))]
    rows = df.select("*", *(c.alias(n) for c, n in zip(bucket, names)))
    starts = sums_before(rows.groupBy(*names).count(), names, "count", "_from", within).drop("count")
    local = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    return rows.withColumn("_n", local).join(starts, names).withColumn(name, (F.col("_from") + F.col("_n")).cast("long")).drop(*names, "_n", "_from")


def by_key(of: DataFrame, each: int = 4096) -> list[Column]:
    """Buckets of about `each` ids for tables ordered by (split_ord, conv_id, ...): as wide as the ids of `of` (conv_id)
    are sparse, from their range and number (an id that repeats makes them narrower)."""
    low, high, n = of.agg(F.min("conv_id"), F.max("conv_id"), F.count("conv_id")).first()
    width = max(1, (high - low + 1) * each // max(1, n)) if n else 1
    return [F.col("split_ord"), F.floor(F.col("conv_id") / width)]


def chunked(df: DataFrame, *order: str, bucket: list[Column], size: int = CHUNK) -> DataFrame:
    """df with chunk_no and pos: exact chunks of `size` rows, the last one short."""
    n = F.col("ordinal")
    return dense_ordinal(df, *order, bucket=bucket).withColumn("chunk_no", F.floor(n / size).cast("long")).withColumn("pos", n % size).drop("ordinal")


def offsets(lengths: DataFrame) -> DataFrame:
    """(chunk_no, lo, hi) from (chunk_no, n): one row a chunk."""
    return sums_before(lengths, ["chunk_no"], "n", "lo").select("chunk_no", "lo", (F.col("lo") + F.col("n")).alias("hi"))


def locate(indexes: DataFrame, of: DataFrame, strict: bool = False) -> DataFrame:
    """(idx, chunk_no, local) by a range join with the offset table; out of range: null chunk, or an error (`strict`).

    Ranges and indexes meet in buckets as wide as the longest chunk, of which a chunk touches two at most: an
    equi-join at any number of chunks."""
    width = of.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 1
    ranges = of.where("hi > lo").select("*", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("_b"))
    both = indexes.withColumn("_b", F.floor(F.col("idx") / width))
    hit = (both["_b"] == ranges["_b"]) & (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))
    found = both.join(ranges, hit, "left")
    number = F.when(F.col("chunk_no").isNull(), F.raise_error(F.concat(F.lit("no chunk has index "), F.col("idx").cast("string"))).cast("long")).otherwise(F.col("chunk_no")) if strict else F.col("chunk_no")
    return found.select("idx", number.alias("chunk_no"), (F.col("idx") - F.col("lo")).alias("local"))


def reconcile(chunks: DataFrame, partials: DataFrame, partial_wins: bool = False) -> DataFrame:
    """All chunk rows; of a number that both have, the chunk's (or the partial's) rows."""
    win, lose = (partials, chunks) if partial_wins else (chunks, partials)
    return lose.join(win.select("chunk_no").distinct(), "chunk_no", "left_anti").unionByName(win)


def missing(numbers: DataFrame, *group: str) -> DataFrame:
    """Chunk numbers that lack between the smallest and the largest, by group."""
    span = numbers.groupBy(*group).agg(F.min("chunk_no").alias("a"), F.max("chunk_no").alias("b"))
    every = span.select(*group, F.explode(F.sequence("a", "b")).alias("chunk_no"))
    return every.join(numbers.select(*group, "chunk_no").distinct(), [*group, "chunk_no"], "left_anti")


def expected_less_present(numbers: DataFrame, first: int, last: int) -> DataFrame:
    return numbers.sparkSession.range(first, last + 1).select(F.col("id").alias("chunk_no")).subtract(numbers.select(F.col("chunk_no").cast("long")))


def merged(chunks: DataFrame, start_chunk: int = 0) -> DataFrame:
    """All rows from a chunk number on, in chunk order."""
    return chunks.where(F.col("chunk_no") >= start_chunk).orderBy("chunk_no", "pos")


def merge_files(spark, paths: list[str], start_chunk: int = 0, on_corrupt: str = "fail", schema=None) -> DataFrame:
    """One scan over all chunk paths; damaged files end the job ('fail') or are left out ('skip')."""
    reader = spark.read.option("ignoreCorruptFiles", on_corrupt == "skip")
    return merged((reader.schema(schema) if schema is not None else reader).parquet(*paths), start_chunk)


def sizes(chunks: DataFrame) -> DataFrame:
    """Rows per split and chunk with roll-up totals (null chunk or split)."""
    return chunks.rollup("split", "chunk_no").agg(F.count("*").alias("n"))


def shuffled(rows: DataFrame, key: Column, seed: int = 0, by: Column | None = None) -> DataFrame:
    """rows with `place`, from 0, in a repeatable order inside each chunk, chunks in order of their numbers. key: Column
    that names a row; by: Column to order by in place of the key's hash with the seed."""
    order = F.xxhash64(F.lit(seed), key) if by is None else by
    dealt = rows.withColumn("place", F.row_number().over(Window.partitionBy("chunk_no").orderBy(order, key)) - 1)
    return dealt.repartitionByRange("chunk_no").sortWithinPartitions("chunk_no", "place")
