"""Dialogues to encoded step rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.arrays import EOS, UNK, with_end
from dialoom.sources.shared import opened

CONV = ("split", "conv_id")
#: Rows that a vocabulary may have to be broadcast; a larger one joins by shuffle.
BROADCAST_WORDS = 1_000_000


def small(table: DataFrame, rows: int = BROADCAST_WORDS) -> DataFrame:
    """The table with a broadcast hint if it is found to have at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def splits(conversations: DataFrame) -> DataFrame:
    """turns (split, split_ord, conv_id, turn, role, text): a conversation table dealt to the three splits."""
    d = F.col("conv_id") % 10
    return conversations.select(F.when(d == 8, "valid").when(d == 9, "test").otherwise("train").alias("split"), F.when(d == 8, 1).when(d == 9, 2).otherwise(0).alias("split_ord"), F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text")


def token_ids(turns: DataFrame, vocab: DataFrame, toks: str = "toks", bounded: bool = False, store: str | None = None, most: int = BROADCAST_WORDS) -> DataFrame:
    """turns with `ids` (ending in EOS) in place of `toks`; words that the vocabulary lacks become UNK.

    bounded: the vocabulary was cut to a size, so it needs no count before it is broadcast. store: a new folder for
    `token_ids_by_file`, which a vocabulary of more than `most` words goes to; turns then has to be read from files.
    One shuffle by (split, conv_id) comes before tokens are exploded; regrouping and later windows reuse it."""
    keys = [*CONV, "turn"]
    dealt = turns.repartition(*CONV)
    words = dealt.select(*keys, F.posexplode_outer(toks).alias("pos", "word"))
    of = vocab.select("word", "idx")
    if store and not bounded and of.limit(most + 1).count() > most:
        return token_ids_by_file(turns, of, store, toks)
    ids = words.join(F.broadcast(of) if bounded else small(of, most), "word", "left")
    ids = ids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("idx", F.lit(UNK)).alias("idx"))))).alias("l"))
    return ids.select(*keys, with_end(F.col("l.idx")).alias("ids"))


def token_ids_by_file(turns: DataFrame, vocab: DataFrame, store: str, toks: str = "toks", each: int = 64, at_once: int = 200_000) -> DataFrame:
    """As `token_ids`, for a vocabulary of any size and a table of files. The distinct words of each file meet the vocabulary,
    so a frequent word crosses once a file; what they find is stored under `store` as a dictionary a file, `each` files
    to a folder. Then each task looks its rows up in place, with the dictionary of the file that it reads: no token is
    shuffled, and no more than one file's dictionary is held, and about `at_once` tokens are looked up at a time."""
    from_file = turns.select(*CONV, "turn", F.col(toks).alias("toks"), F.col("_metadata.file_path").alias("file"))
    folders = max(1, len(turns.inputFiles()) // each)
    folder = lambda: F.pmod(F.xxhash64("file"), F.lit(folders)).cast("int")
    words = from_file.select("file", F.explode(F.array_distinct("toks")).alias("word")).distinct()
    found = words.join(vocab.select("word", "idx"), "word").withColumn("folder", folder())
    found.repartition("folder").sortWithinPartitions("folder", "file").write.partitionBy("folder").parquet(store)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, idx = None, None, None
        system, root = opened(store)
        pool = pa.default_memory_pool()
        for b in batches:
            files = b.column("file").dictionary_encode()
            for code, file in enumerate(files.dictionary.to_pylist()):
                part = b.filter(pc.equal(files.indices, code)) if len(files.dictionary) > 1 else b
                if file != held:
                    path = f"{root}/folder={part.column('folder')[0].as_py()}"
                    there = system.get_file_info(path).type.name == "Directory"  # none of its words is in the vocabulary
                    known = pq.read_table(path, filesystem=system, filters=[("file", "=", file)], columns=["word", "idx"], partitioning=None) if there else pa.table({"word": pa.array([], pa.string()), "idx": pa.array([], pa.int32())})
                    held, words, idx = file, known["word"].combine_chunks(), np.append(np.asarray(known["idx"].combine_chunks(), np.int32), np.int32(UNK))
                for a, z in cuts(part.column("toks")):
                    yield own_ids(part.slice(a, z - a), words, idx)
                part = None
            b = files = None
            pool.release_unused()

    def cuts(lists: pa.Array) -> Iterator[tuple[int, int]]:
        """Runs of rows with about `at_once` tokens, one row at least."""
        n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        group = (np.cumsum(n) - n) // at_once
        edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
        return zip(edge, edge[1:])

    def own_ids(part: pa.RecordBatch, words: pa.Array, idx: np.ndarray) -> pa.RecordBatch:
        lists = part.column("toks")
        n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        at = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1))
        ends = np.concatenate([[0], np.cumsum(n + 1)])
        ids = np.full(ends[-1], EOS, np.int32)
        mask = np.ones(ends[-1], bool)
        mask[ends[1:] - 1] = False
        ids[mask] = idx[at]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in (*CONV, "turn")), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], [*CONV, "turn", "ids"])

    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in (*CONV, "turn"))
    return from_file.withColumn("folder", folder()).mapInArrow(look_up, f"{kinds}, ids array<int>")


def long_enough(turns: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*CONV))
    kept = turns.withColumn("_n", n).where(F.col("_n") >= least)
    return (kept.where(F.col("_n") <= most) if most else kept).drop("_n")


def steps(ids: DataFrame) -> DataFrame:
    """(split, conv_id, step, x_ref, x_t, target, gate): each utterance after the first is a speak step."""
    w = Window.partitionBy(*CONV).orderBy("turn")
    rows = ids.select(*CONV, F.row_number().over(w).alias("r"), F.first("ids").over(w).alias("x_ref"), F.lag("ids").over(w).alias("x_t"), F.col("ids").alias("target"))
    return rows.where("r > 1").select(*CONV, (F.col("r") - 2).alias("step"), "x_ref", "x_t", "target", F.lit(1.0).alias("gate"))


def with_thinking(rows: DataFrame, k: int) -> DataFrame:
    """k think steps (NULL, [], 0) before every speak step."""
    out = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k))))
    speak = F.col("k") == k
    return out.select(*CONV, (F.col("step") * (k + 1) + F.col("k")).alias("step"), "x_ref", F.when(speak, F.col("x_t")).alias("x_t"), F.when(speak, F.col("target")).otherwise(F.array().cast("array<int>")).alias("target"), F.when(speak, F.col("gate")).otherwise(0.0).alias("gate"))


def speaks(gate: Column) -> Column:
    """gate >= 1, where NaN isn't."""
    return ~F.isnan(gate) & (gate >= 1)


def step_format(rows: DataFrame, encode) -> DataFrame:
    """Steps (split, conv_id, step, x_ref, x_t, target, gate) of step inputs (split, conv_id, pos, input_text, target_text,
    gate): a null input is the last one before it that isn't null ('' is no null), and the reference is the first input
    that isn't empty. encode: Column of text -> Column of ids with EOS. Each row's own texts are encoded once, and the
    ids are carried forward in place of the texts."""
    speak, none = F.coalesce(speaks(F.col("gate")), F.lit(False)), F.array(F.lit(EOS))
    w = Window.partitionBy(*CONV).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = rows.select(*CONV, "pos", speak.alias("speak"), (F.col("input_text") != "").alias("full"), F.when(F.col("input_text").isNotNull(), encode(F.col("input_text"))).alias("input"), encode(F.when(speak, F.coalesce("target_text", F.lit("")))).alias("target"))
    own = own.withColumns({"x_t": F.coalesce(F.last("input", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), none), "x_ref": F.coalesce(F.first(F.when(F.col("full"), F.col("input")), ignorenulls=True).over(whole), none)})
    return own.select(*CONV, F.col("pos").alias("step"), "x_ref", F.when(F.col("speak"), F.col("x_t")).alias("x_t"), F.when(F.col("speak"), F.col("target")).otherwise(F.array().cast("array<int>")).alias("target"), F.when(F.col("speak"), 1.0).otherwise(0.0).alias("gate"))


def decoded(rows: DataFrame, decode: DataFrame, ids: str = "ids", max_len: int = 100) -> DataFrame:
    """rows (key, ids) -> (key, words): padding skipped, stops after the first EOS, unknown ids as <UNK:id>, and
    <...> at position max_len, where padding counts as positions."""
    at = F.array_position(ids, EOS)
    cut = F.when(at > 0, F.slice(F.col(ids), F.lit(1), F.least(at.cast("int"), F.lit(max_len)))).otherwise(F.slice(F.col(ids), 1, max_len))
    over = F.when(at > 0, at > max_len).otherwise(F.size(ids) > max_len)
    items = rows.select("key", over.alias("over"), F.posexplode_outer(cut).alias("pos", "idx")).join(small(decode), "idx", "left")
    word = F.when((F.col("idx").isNotNull()) & (F.col("idx") != 0), F.struct("pos", F.coalesce("word", F.format_string("<UNK:%d>", "idx")).alias("word")))
    out = items.groupBy("key").agg(F.sort_array(F.collect_list(word)).alias("l"), F.max("over").alias("over"))
    return out.select("key", F.when(F.col("over"), F.array_append("l.word", "<...>")).otherwise(F.col("l.word")).alias("words"))
