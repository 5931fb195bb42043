"""Structured Streaming forms: live encoding with resume, following chunks, running counts and metrics."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from dialoom.functions.text import clean, kept_kinds, number_rule, tokens
from dialoom.operators.chunks import dense_ordinal
from dialoom.sources.io import _list_of, exists
from dialoom.streaming import sources

BLOCK = 1000
LOG_FILES = "spark.sql.streaming.checkpointFileManagerClass"


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda l: None if l is None else [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in l])


def segmenter(words: Callable[[str], list[str]]):
    """Column function array<string> -> array<array<string>> that applies a plain Python function from a cleaned text to
    its words, such as a word segmenter, to all utterances of a line in Arrow batches."""

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def segment(texts: pd.Series) -> pd.Series:
        return texts.map(lambda l: None if l is None else [[] if x is None else list(words(x)) for x in l])

    return segment


def _texts(value: Column) -> Column:
    """The utterances of a line in the string or utterance format."""
    def text(e: Column) -> Column:
        kind = F.schema_of_variant(e)
        own = F.try_variant_get(e, "$.text", "variant")
        return F.when(kind.startswith("OBJECT"), F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(e, "$.text", "string")).otherwise("")).when(kind == "STRING", F.try_variant_get(e, "$", "string")).otherwise("")

    return F.transform(_list_of(value), text)


def encoded_lines(lines: DataFrame, encode, tokenizer=None, segment=None) -> DataFrame:
    """(value, x_ref, steps): each line's dialogue in one row, without state; bad and short lines are left out.

    encode: as `io.encoder` makes it. tokenizer: as of `text.tokens`; it is applied inside an array, so it has to be built of
    Spark's own functions. segment: a `segmenter` in its place."""
    rows = lines.withColumn("texts", _texts(F.col("value"))).where(F.size("texts") >= 2)
    other = F.exists("texts", lambda x: x.rlike(r"[^\x00-\x7F]"))  # lines of ASCII alone don't travel to Python
    rows = rows.withColumn("texts", F.coalesce(_nfkc_all(F.when(other, F.col("texts"))), "texts"))
    if segment is not None:
        cleaned = segment(F.transform("texts", lambda x: clean(x, normalise=False)))
        rows = rows.withColumn("toks", F.transform(cleaned, lambda w: number_rule(kept_kinds(w))))
    else:
        rows = rows.withColumn("toks", F.transform("texts", lambda x: tokens(x, normalise=False, tokenizer=tokenizer)))
    rows = rows.withColumn("ids", encode.lines(F.col("toks")))  # nothing else needs the words, so they are found once
    steps = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(F.get("ids", k - 1).alias("x_t"), F.get("ids", k).alias("target"), F.lit(1.0).alias("gate")))
    return rows.withColumn("x_ref", F.get("ids", F.lit(0))).withColumn("steps", steps).drop("texts", "toks", "ids")


def live_encode(spark: SparkSession, source: str, target: str, checkpoint: str, encode, max_files: int | None = None, block: int = BLOCK, tokenizer=None, segment=None):
    """Start encoding JSONL files of a folder as they come; written in blocks, resumed from the checkpoint. Returns
    the streaming query (available-now: it ends when the files there are done)."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(source).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("part"))

    def put(rows: DataFrame, batch: int) -> None:
        numbered = dense_ordinal(rows.withColumn("id", F.monotonically_increasing_id()), "id", bucket=[F.col("file_path"), F.col("part")])
        out = numbered.withColumn("batch_id", F.lit(batch)).withColumn("block", F.floor(F.col("ordinal") / block)).drop("id", "ordinal", "part", "file_path")
        out.write.mode("overwrite").parquet(f"{target}/batch_id={batch}")  # a batch that runs again replaces itself

    return encoded_lines(lines, encode, tokenizer, segment).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, target: str) -> DataFrame:
    """(file_path, next_line) of `live_encode_growing`'s target: where each file goes on, as a number of lines."""
    lines = f"{target}/_lines"
    if not exists(spark, lines):
        return spark.createDataFrame([], "file_path string, next_line bigint")
    return spark.read.schema("file_path string, n bigint").parquet(lines).groupBy("file_path").agg(F.sum("n").alias("next_line"))


def live_encode_growing(spark: SparkSession, source: str, target: str, checkpoint: str, encode, block: int = BLOCK, start_line: int = 0, tokenizer=None, segment=None):
    """As `live_encode`, of a JSONL file (or a folder of such) that others append to: each run goes on at the line after
    the last one it read. line_no numbers a file's lines from 0 over all runs, bad ones included; those before
    `start_line` are left out. The lines of each batch are counted in the target's folder _lines, see `progress`."""
    sources.register(spark)
    stream = spark.readStream.format("growing_lines").option("path", source).load()

    def put(rows: DataFrame, batch: int) -> None:
        rows = dense_ordinal(rows, "byte", bucket=[F.col("file_path"), F.col("block")]).persist()
        own = f"{target}/_lines/batch_id={batch}"
        files = rows.groupBy("file_path").agg(F.min("ordinal").alias("first"), F.count("*").alias("n"))
        before = progress(spark, target).where("next_line > 0") if batch else spark.createDataFrame([], "file_path string, next_line bigint")
        if exists(spark, own):  # this batch runs again
            before = before.join(spark.read.schema("file_path string, n bigint").parquet(own).withColumnRenamed("n", "again"), "file_path", "left").select("file_path", (F.col("next_line") - F.coalesce("again", F.lit(0))).alias("next_line"))
        numbers = F.broadcast(files.join(before, "file_path", "left").select("file_path", (F.coalesce("next_line", F.lit(0)) - F.col("first")).alias("shift"), "n"))  # a row a file: MOST_FILES at most
        lines = rows.join(numbers.drop("n"), "file_path").withColumn("line_no", F.col("ordinal") + F.col("shift")).where(F.col("line_no") >= start_line)
        encoded = encoded_lines(lines, encode, tokenizer, segment).withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))
        encoded = dense_ordinal(encoded.drop("ordinal"), "byte", bucket=[F.col("file_path"), F.col("block")])
        out = encoded.withColumns({"batch_id": F.lit(batch), "block": F.floor(F.col("ordinal") / block)}).drop("ordinal", "byte", "shift", "file_path")
        out.write.mode("overwrite").parquet(f"{target}/batch_id={batch}")  # a batch that runs again replaces itself
        files.select("file_path", "n").write.mode("overwrite").parquet(own)
        rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_numbered(spark: SparkSession, directory: str, schema, checkpoint: str, chunks_per_trigger: int = 1, gaps: str = "wait", first_chunk: int = 0, task_bytes: int = 16 << 20) -> DataFrame:
    """A stream of the chunks of a folder in the order of their numbers, so many a batch, whenever they were written; the
    schema may name chunk_no. No chunk at all is an error. checkpoint: that of the query. task_bytes: small chunks of a
    batch share tasks up to so many bytes. `drained` runs it to its end."""
    if not any(sources.CHUNK_RE.search(p) for p in sources.listed(directory)):
        raise ValueError(f"no chunks under {directory}")
    sources.register(spark)
    options = {"path": directory, "checkpoint": checkpoint, "chunksPerTrigger": chunks_per_trigger, "gaps": gaps, "firstChunk": first_chunk, "taskBytes": task_bytes}
    return spark.readStream.format("numbered_chunks").schema(schema).options(**options).load()


def drained(writer, checkpoint: str | None = None) -> None:
    """Start a stream's writer, wait until nothing is left to read, and stop it. checkpoint: the writer's, if it has none yet.

    For a checkpoint named here that lies on a local disk, files of its logs are moved into place by FileSystem, as Spark
    itself does where there is no FileContext, which starts many processes a batch there for modes and links."""
    conf = SparkSession.active().conf
    local = checkpoint is not None and re.match(r"file:|(?!\w+:)", checkpoint) is not None and conf.get(LOG_FILES, None) is None
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    if local:
        conf.set(LOG_FILES, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        running = writer.start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    finally:
        if local:
            conf.unset(LOG_FILES)


def follow_chunks(spark: SparkSession, directory: str, schema, files_per_trigger: int = 1, max_bytes: str | None = None) -> DataFrame:
    """A stream of new chunk files, so many at a time."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def running_counts(lines: DataFrame) -> DataFrame:
    """Word counts of a stream (text); the state holds the vocabulary."""
    return lines.select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").count()


def running_metrics(log: DataFrame) -> DataFrame:
    """Loss sum, steps and mean per split of a stream (split, loss)."""
    return log.groupBy("split").agg(F.sum("loss").alias("loss_sum"), F.count("*").alias("steps")).withColumn("avg_loss", F.col("loss_sum") / F.col("steps"))
