"""Readers and writers: dialogue JSONL, vocabularies, logs, chunk files and file inventories."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.operators.chunks import dense_ordinal
from dialoom.sources.shared import opened

SPLITS = (("train", 0), ("valid", 1), ("test", 2))
STEP_KEYS = ("input_text", "target_text", "gate_signal")
METRICS = "epoch int, total_steps bigint, avg_step_loss double, lr double, gate_mean double, token_ce double, gate_bce double, think_nce double, split string"
TRACE = "t string, x_t_ids array<int>, gate_prob_mean double, temperature double, loss double, comps map<string,double>, pred_token int, topk array<array<double>>, is_speak_step boolean"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def _raw_lines(spark: SparkSession, path: str, split: str, split_ord: int) -> DataFrame:
    file, block = F.col("_metadata.file_path").alias("file_path"), F.floor(F.col("_metadata.file_block_start") / (1 << 20)).alias("block")
    return spark.read.text(path).select(F.lit(split).alias("split"), F.lit(split_ord).alias("split_ord"), "value", F.col("_metadata.file_name").alias("file_name"), file, block, F.monotonically_increasing_id().alias("id"))


def _numbered(raw: DataFrame) -> DataFrame:
    out = dense_ordinal(raw, "id", bucket=[F.col("split_ord"), F.col("file_path"), F.col("block")], name="line_no", within=1)
    return out.select("split", "split_ord", "file_name", "line_no", "value")


def read_lines(spark: SparkSession, path: str, split: str = "train", split_ord: int = 0) -> DataFrame:
    """(split, split_ord, file_name, line_no, value): lines in file order, numbered from 0 over all files."""
    return _numbered(_raw_lines(spark, path, split, split_ord))


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The three splits in their fixed order, each numbered from 0; a split without a file is left out."""
    found = [_raw_lines(spark, paths[name], name, k) for name, k in SPLITS if name in paths and exists(spark, paths[name])]
    if not found:
        return spark.createDataFrame([], "split string, split_ord int, file_name string, line_no bigint, value string")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _numbered(out)


def _list_of(value: Column) -> Column:
    """The line's JSON list as array<variant>; null if the line is no JSON, or no list, or has text after it."""
    v = F.when(value.rlike(r"\]\s*$"), F.try_parse_json(value))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that aren't a JSON list: (file_name, line_no, value)."""
    return lines.where(_list_of(F.col("value")).isNull()).select("file_name", "line_no", "value")


def _field(e: Column, name: str) -> Column:
    """A text field: null if it lacks or is null, '' if it isn't a text."""
    kind = F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant"))
    return F.when(kind.isNull() | (kind == "VOID"), F.lit(None).cast("string")).when(kind == "STRING", F.try_variant_get(e, f"$.{name}", "string")).otherwise("")


def elements(lines: DataFrame) -> DataFrame:
    """One row an element of each well-formed line: (split, split_ord, conv_id, pos, n, format, is_object, text,
    input_text, target_text, gate, junk). Formats: 'step' if any object has a step key (a null value counts),
    'strings' if all are texts, else 'utterance'."""
    rows = lines.select("split", "split_ord", F.col("line_no").alias("conv_id"), _list_of(F.col("value")).alias("l")).where(F.size("l") > 0)
    e = F.col("e")
    kind = F.schema_of_variant(e)
    keys = F.map_keys(F.try_variant_get(e, "$", "map<string,variant>"))
    rows = rows.select("split", "split_ord", "conv_id", F.size("l").alias("n"), F.posexplode("l").alias("pos", "e"))
    plain = F.when(kind == "STRING", F.try_variant_get(e, "$", "string")).when(kind == "BOOLEAN", F.when(F.try_variant_get(e, "$", "boolean"), "True").otherwise("")).when(kind == "VOID", "").otherwise(F.when(F.try_variant_get(e, "$", "double") == 0, "").otherwise(F.coalesce(F.try_variant_get(e, "$", "string"), F.to_json(e))))
    as_text, as_number = F.try_variant_get(e, "$.gate_signal", "string"), F.try_variant_get(e, "$.gate_signal", "double")
    is_object = kind.startswith("OBJECT")
    rows = rows.select(
        "split", "split_ord", "conv_id", "n", "pos", is_object.alias("is_object"), (kind == "STRING").alias("is_text"), F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, STEP_KEYS))), F.lit(False)).alias("is_step"),
        F.when(is_object, F.coalesce(_field(e, "text"), F.lit(""))).otherwise(plain).alias("text"), _field(e, "input_text").alias("input_text"), _field(e, "target_text").alias("target_text"),
        F.coalesce(as_number, F.lit(0.0)).alias("gate"), (as_text.isNotNull() & (as_text != "") & as_number.isNull()).alias("junk"),
    )
    w = Window.partitionBy("split", "conv_id")
    shape = F.when(F.bool_or("is_step").over(w), "step").when(F.bool_and("is_text").over(w), "strings").otherwise("utterance")
    return rows.withColumns({"format": shape, "broken": F.bool_or(F.col("is_object") & F.col("junk")).over(w)})


def counted_texts(parts: DataFrame) -> DataFrame:
    """(split_ord, conv_id, turn, field, text): what the vocabulary counts, of objects text, input and target text
    in this order, or the bare text; other kinds don't count."""
    texts = F.when(F.col("is_object"), F.array("text", "input_text", "target_text")).when(F.col("is_text"), F.array("text")).otherwise(F.array().cast("array<string>"))
    return parts.select("split_ord", "conv_id", F.col("pos").alias("turn"), F.posexplode(texts).alias("field", "text")).where("text <> ''")


def utterances(parts: DataFrame, least: int = 2) -> DataFrame:
    """turns (split, split_ord, conv_id, turn, text) of string and utterance dialogues of `least` elements or more."""
    return parts.where((F.col("format") != "step") & (F.col("n") >= least)).select("split", "split_ord", "conv_id", F.col("pos").alias("turn"), "text")


def step_inputs(parts: DataFrame) -> DataFrame:
    """Step rows of step dialogues, numbered over their objects; a dialogue with a gate that is no number is dropped."""
    rows = parts.where((F.col("format") == "step") & F.col("is_object") & ~F.col("broken"))
    n = F.row_number().over(Window.partitionBy("split", "conv_id").orderBy("pos")) - 1
    return rows.select("split", "split_ord", "conv_id", n.alias("pos"), "input_text", "target_text", "gate")


def encoder(vocab: DataFrame, unknown: int = 3, end: int = 2, most: int = 1_000_000):
    """Column function array<string> -> array<int> with the end mark: a dictionary lookup in Arrow batches. Its attribute
    `lines` is the same for array<array<string>>. A vocabulary of over `most` words is an error: `encode.token_ids`
    joins one of any size."""
    rows = vocab.select("word", "idx").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"a vocabulary of over {most} words; join it with encode.token_ids")
    shared = vocab.sparkSession.sparkContext.broadcast((rows["word"].combine_chunks(), np.append(rows["idx"].to_numpy(), unknown).astype(np.int32)))

    def found(lists: pa.ListArray) -> pa.ListArray:
        words, idx = shared.value
        n = np.asarray(pc.fill_null(pc.list_value_length(lists), -1), np.int64) + 1  # a null list has no end mark
        at = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1), np.int64)
        ends = np.cumsum(n)
        ids, own = np.full(n.sum(), end, np.int32), np.ones(n.sum(), bool)
        own[ends[n > 0] - 1] = False
        ids[own] = idx[at]  # -1: the last one
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))

    @F.arrow_udf("array<int>")
    def encode(tokens: pa.Array) -> pa.Array:
        return found(tokens)

    @F.arrow_udf("array<array<int>>")
    def lines(texts: pa.Array) -> pa.Array:
        n = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), found(texts.flatten()), mask=texts.is_null())

    encode.lines = lines
    return encode


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """The vocabulary as one JSON document: word2index, word2count (always 1, as the format has it), index2word,
    num_words, trimmed, name."""
    entries = lambda *c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(*c))))
    i2w = F.map_concat(F.create_map(*(F.lit(x) for x in ("0", "PAD", "1", "SOS", "2", "EOS", "3", "UNK"))), entries(F.col("idx").cast("string"), "word"))
    doc = vocab.agg(entries("word", "idx").alias("word2index"), entries("word", F.lit(1)).alias("word2count"), i2w.alias("index2word"), (F.count("*") + 4).alias("num_words"), F.lit(False).alias("trimmed"), F.lit("vocab").alias("name"))
    doc.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_statistics(counts: DataFrame, path: str, min_freq: int = 2) -> None:
    top = counts.orderBy(F.desc("n"), "first_seen").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_seen", "word", "n"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"))).alias("top_10_words"))
    total = counts.agg(F.count_if(F.col("n") >= min_freq).alias("vocab_size"), F.sum("n").alias("total_words_processed"), F.count("*").alias("unique_words_found"), F.lit(min_freq).alias("min_frequency"))
    total.join(F.broadcast(top)).select(F.to_json(F.struct("*")).alias("value")).write.text(path)  # one row and one row


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, idx) from the JSON document; its index2word keys are texts."""
    doc = spark.read.option("multiLine", True).schema("word2index map<string,int>, index2word map<string,string>").json(path)
    return doc.select(F.explode("word2index").alias("word", "idx"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.option("multiLine", True).schema("index2word map<string,string>").json(path)
    return doc.select(F.explode("index2word").alias("idx", "word")).select(F.col("idx").cast("int"), "word")


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).csv(path, header=True)


def write_traces(rows: DataFrame, path: str) -> None:
    """Records (chunk, steps, record) as a JSON list document for each (chunk, steps), under names
    detail_trace_<chunk>_<steps>.json (folders, as Spark names files itself)."""
    name = F.format_string("detail_trace_%d_%d.json", "chunk", "steps")
    rows.groupBy(name.alias("name")).agg(F.to_json(F.collect_list("record")).alias("value")).write.partitionBy("name").text(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Step traces with chunk and step number from files, or folders of files, named detail_trace_<chunk>_<steps>.json."""
    name = F.col("_metadata.file_path")
    number = lambda k: F.regexp_extract(name, r"detail_trace_(\d+)_(\d+)\.json(?:/[^/]*)?$", k).try_cast("int")
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(TRACE).json(path).withColumns({"chunk": number(1), "steps": number(2)})
    return rows.withColumn("topk", F.transform("topk", lambda x: F.struct(x[0].cast("int").alias("id"), x[1].alias("p"))))


def parse_thinking(lines: DataFrame) -> DataFrame:
    """(step, t, gate_p, topk) from lines `step=S, t=T, gate_p=P, topK: id:p, id:p`."""
    v = F.col("value")
    head = r"^step=(\d+), t=(\d+), gate_p=([0-9.eE+-]+), top\d+: ?(.*)$"
    pairs = F.transform(F.filter(F.split(F.regexp_extract(v, head, 4), r",\s*"), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[0].try_cast("int").alias("id"), F.split(x, ":")[1].try_cast("double").alias("p")))
    return lines.where(v.rlike(head)).select(F.regexp_extract(v, head, 1).cast("bigint").alias("step"), F.regexp_extract(v, head, 2).cast("int").alias("t"), F.regexp_extract(v, head, 3).try_cast("double").alias("gate_p"), pairs.alias("topk"))


def inventory(spark: SparkSession, *globs: str) -> DataFrame:
    """(path, directory, name, kind, number, bytes) of all files, each once; contents aren't read."""
    out = None
    for g in globs:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(g).select("path", "length")
        out = one if out is None else out.union(one)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike(r"^chunk_\d+\."), "chunk").when(name.rlike(r"^partial_\d+\."), "partial").when(name.rlike(r"\.jsonl$"), "raw").otherwise("merged")
    return out.distinct().select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), name.alias("name"), kind.alias("kind"), F.regexp_extract(name, r"^(?:chunk|partial)_(\d+)\.", 1).try_cast("int").alias("number"), F.col("length").alias("bytes"))


def write_chunks(rows: DataFrame, path: str) -> None:
    """Rows (split, chunk_no, pos, ...) in a directory for each chunk. Tasks move their own files into place; the driver
    would move one after the other."""
    writer = rows.repartition("split", "chunk_no").sortWithinPartitions("split", "chunk_no", "pos").write.option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer.partitionBy("split", "chunk_no").parquet(path)


def write_small(rows: DataFrame, path: str, by: str) -> None:
    """Append rows to a folder `by`=number for each number, as `partitionBy` lays them out, for many small files. Rows of
    equal numbers have to be neighbours in their task. Each file is written under a hidden name and moved into place whole;
    a task that runs again replaces its files. Spark's own writer starts processes for each file on a local disk."""
    call = uuid.uuid4().hex

    def put(batches):
        task = TaskContext.get()
        system, root = opened(path)
        out = writer = number = None
        folder, name, hidden, n = "", f"part-{task.partitionId():05d}-{call}.parquet", f".part-{task.taskAttemptId()}-{call}", 0

        def close():
            if writer is not None:
                writer.close()
                out.close()
                system.move(f"{folder}/{hidden}", f"{folder}/{name}")

        for b in batches:
            if b.column(by).null_count:
                raise ValueError(f"{by} is null")
            values = b.column(by).to_numpy()
            rest = b.select([c for c in b.schema.names if c != by])
            cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    if writer is None or values[low] != number:
                        close()
                        number, folder = values[low], f"{root}/{by}={values[low]}"
                        system.create_dir(folder, recursive=True)
                        out = system.open_output_stream(f"{folder}/{hidden}")
                        writer = pq.ParquetWriter(out, rest.schema)
                    writer.write_batch(rest.slice(low, high - low))
            n += b.num_rows
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows in numeric chunk order; no chunk at all is an error."""
    rows = spark.read.parquet(path)
    if rows.isEmpty():
        raise ValueError(f"no chunks under {path}")
    return rows.orderBy("split", "chunk_no", "pos")


def write_merged(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("split", "chunk_no", "pos").sortWithinPartitions("split", "chunk_no", "pos").write.partitionBy("split").parquet(path)
