"""Helpers that the corpus operators share: tables, scratch tables, words and hashes.

A *word* is a maximal run of characters other than space and U+0009..U+000D; letters A-Z are
lower-cased first. All per-row Python here works on Arrow batches inside Spark tasks.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder of spark.checkpoint.dir. Where that is unset it is set to a temporary folder
    if Spark runs in this process alone; on a cluster, whose machines wouldn't share it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends at files that outlive executors. by: a column
    whose values go to folders of their own, so that readers of one value leave the others out; it becomes the last."""
    path = scratch(df.sparkSession, what)
    out = df.write.option("compression", codec)
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_arrays(folder: str, arrays: dict[str, np.ndarray]) -> None:
    """Each array as <name>.npy in a folder that all machines share."""
    system, root = _opened(folder)
    system.create_dir(root, recursive=True)
    for name, x in arrays.items():
        with system.open_output_stream(f"{root}/{name}.npy") as out:
            np.lib.format.write_array(out, np.ascontiguousarray(x), allow_pickle=False)


def load_arrays(folder: str, names: list[str]) -> dict[str, np.ndarray]:
    """The arrays that `save_arrays` wrote. Files that this machine can map are mapped, so all its workers share one
    copy; others are read."""
    system, root = _opened(folder)
    if isinstance(system, fs.LocalFileSystem):
        return {n: np.asarray(np.load(os.path.join(root, f"{n}.npy"), mmap_mode="r")) for n in names}
    out = {}
    for n in names:
        with system.open_input_file(f"{root}/{n}.npy") as f:
            out[n] = np.lib.format.read_array(f, allow_pickle=False)
    return out


def _opened(path: str):
    local = re.sub(r"^file:(?://)?", "", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


def slim() -> None:
    """Give memory that this Python worker has freed, but its allocators keep, back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slimmed(run):
    """run (a function for mapInArrow) that leaves no freed memory with the worker: before, what other stages left, and
    after the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slim()
        yield from run(batches)
        slim()

    return task


def in_place(docs: DataFrame, run) -> DataFrame:
    """docs after mapInArrow(run), whatever its columns are called: run gets and gives batches of its columns in their
    order, named c0, c1, ..."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(slimmed(run), plain.schema).toDF(*names)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of `taken` (whatever the case)."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; a null id has the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about `limit` bytes of the text column, at least one row."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class Words:
    """The words of a text array: `ids` index into `words` (distinct), text i has ids[start[i]:start[i+1]]."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")  # a copy: ascii_lower misreads slices
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten()
        start = np.asarray(lists.offsets, dtype=np.int64)
        start = start - start[0]
        coded = pc.dictionary_encode(flat) if len(flat) else pa.array([], pa.large_string()).dictionary_encode()
        ids = np.asarray(coded.indices, dtype=np.int64)
        words = coded.dictionary
        empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
        if empty >= 0:  # splitting leaves '' at either end of a text
            keep = ids != empty
            kept = np.concatenate([[0], np.cumsum(keep)])
            ids, start = ids[keep], kept[start]
        self.ids, self.start, self.words = ids, start, words
        self.lengths = np.diff(start)

    def rows(self) -> np.ndarray:
        """For each word its text's number."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words: eight bytes at a time through a mixer, for all words at once."""
    raw = words.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.concatenate([np.frombuffer(raw.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    at, n = ends[:-1].copy(), np.diff(ends)
    out, live = mix(n.astype(np.uint64) + np.uint64(1)), np.flatnonzero(n > 0)
    while len(live):
        left = ends[live + 1] - at[live]
        x = eights[at[live]].copy().view("<u8").ravel()
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        with np.errstate(over="ignore"):
            out[live] = mix((out[live] ^ mix(x)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
        at[live] += 8
        live = live[left > 8]
    return out


#: Bytes of a word are the digits of a number to this (odd) base, modulo 2**64: powers of it and of its inverse for a block of bytes.
BASE, BLOCK, LONG = 0x9E3779B97F4A7C55, 1 << 16, 64
POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + LONG, BASE, np.uint64)]), dtype=np.uint64)
INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK + LONG, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
ENDS = mix(np.arange(LONG + 1, dtype=np.uint64) + np.uint64(1))


class HashedWords:
    """As `Words` (lower-cased), where the words themselves aren't needed: ids index into 64-bit `hashes` of the distinct words,
    lengths are the texts' numbers of words. Words of over LONG bytes are hashed by `word_hashes`."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        border = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[border[0] : border[-1]]
        border = border - border[0]
        data = data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
        solid = (data != 32) & ((data - np.uint8(9)) >= 5)
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = border[(border > 0) & (border < len(data))]
        begins[inner], ends[inner - 1] = solid[inner], solid[inner - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.lengths = np.diff(np.searchsorted(first, border))
        coded = pc.dictionary_encode(pa.array(self._numbers(data, first, last)))
        self.ids, self.hashes = np.asarray(coded.indices, dtype=np.int64), mix(np.asarray(coded.dictionary))

    @staticmethod
    def _numbers(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n, out = last - first, np.empty(len(first), np.uint64)
        cuts = np.searchsorted(first, np.arange(0, len(data) + BLOCK, BLOCK)).tolist()
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            a = k * BLOCK
            part = data[a : a + BLOCK + LONG]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * POWERS[: len(part)], out=sums[1:])
            at = first[i:j] - a
            out[i:j] = (sums[np.minimum(last[i:j] - a, len(part))] - sums[at]) * INVERSE[at] + ENDS[np.minimum(n[i:j], LONG)]
        long = np.flatnonzero(n > LONG)
        if len(long):
            out[long] = word_hashes(pa.array([data[a:z].tobytes() for a, z in zip(first[long].tolist(), last[long].tolist())], pa.large_binary()))
        return out


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours in a flat hash array (runs over text ends are the caller's to drop)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - k + 1 + i]
    return mix(out)


def whole_runs(lengths: np.ndarray, start: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask over run starts 0..total-k: True where the run of k lies in one text."""
    if total < k:
        return np.zeros(0, bool)
    left = np.repeat(start[1:], lengths) - np.arange(total)
    return left[: total - k + 1] >= k


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each list element, element) of a list column."""
    return np.repeat(np.arange(len(column)), np.asarray(pc.fill_null(pc.list_value_length(column), 0))), np.asarray(column.flatten())


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] times, then first[1] ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def dealt(rows: dict[str, np.ndarray], ragged: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> pa.RecordBatch:
    """Columns of many rows as one row for each value of `bucket`, with array columns: moving these costs Spark far
    less than the rows would. ragged: name to (row, element), in order of rows; goes with a column of its lengths."""
    few = len(rows["bucket"]) and rows["bucket"].max() < 1 << 16
    order = np.argsort(rows["bucket"].astype(np.uint16) if few else rows["bucket"], kind="stable")  # 16 bits are sorted by radix
    bucket = rows["bucket"][order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    cut = np.append(first, len(bucket)).astype(np.int32)
    names, columns = ["bucket"], [pa.array(bucket[first].astype(np.int32))]
    for name, x in rows.items():
        if name != "bucket":
            names.append(name)
            columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(x[order])))
    for name, (row, x) in (ragged or {}).items():
        n = np.bincount(row, minlength=len(order))
        by = spans((np.cumsum(n) - n)[order], n[order])
        n = n[order]
        ends = np.concatenate([[0], np.cumsum(n)])
        names += [name, f"n_{name}"]
        columns += [pa.ListArray.from_arrays(pa.array(ends[cut].astype(np.int32)), pa.array(x[by])), pa.ListArray.from_arrays(pa.array(cut), pa.array(n.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, names)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each bucket of `dealt` rows that come sorted by bucket."""
    held: list[pa.RecordBatch] = []

    def joined() -> dict[str, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks()
        return {n: np.asarray(whole[n].combine_chunks().flatten()) for n in whole.column_names if n != "bucket"}

    for b in batches:
        if not b.num_rows:
            continue
        bucket = np.asarray(b.column(0))
        for a, z in zip(*(lambda c: (np.append(0, c), np.append(c, len(bucket))))(np.flatnonzero(np.diff(bucket)) + 1)):
            if held and held[-1].column(0)[0].as_py() != bucket[a]:
                yield joined()
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield joined()


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the distinct keys of all parts (keys, counts)."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def hash_counts(rows: DataFrame, hashes, buckets: int, least: int = 1) -> DataFrame:
    """(h, n): how often each 64-bit hash occurs, where that is `least` times or more. hashes: from a batch of `rows`
    an iterator of (hashes, times). Each task adds up its own, and each bucket of hashes is added up in a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for h, n in hashes(b):
                held.append((h, n))
                size += len(h)
                if size > 2_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged(held))

    def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return dealt({"bucket": ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), "h": h.view(np.int64), "n": n})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_bucket(batches):
            h, n = merged([(x["h"].view(np.uint64), x["n"])])
            h, n = h[n >= least], n[n >= least]
            for a in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 200_000].view(np.int64)), pa.array(n[a : a + 200_000])], ["h", "n"])

    arrays = rows.mapInArrow(count, "bucket int, h array<long>, n array<long>")
    return arrays.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "h long, n long")


def buckets_for(spark: SparkSession, rows: int, each: int) -> int:
    """Buckets of about `each` rows, and no fewer than shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


#: A table of counts has at most 2**MOST_CELLS cells of one byte.
MOST_CELLS = 27


class Cells:
    """Counts of 64-bit hashes on a log scale, one byte a cell; a cell, picked by a hash's top bits, has the largest
    count of its hashes, so a count is never too small, and 0 where no hash was filed."""

    def __init__(self, counts: DataFrame):
        """counts: (h, n), stored. There are 8 cells for each row, up to 2**MOST_CELLS."""
        rows = counts.count()
        self.bits = int(min(MOST_CELLS, max(16, np.ceil(np.log2(8 * rows + 1)))))
        cell = F.shiftrightunsigned("h", 64 - self.bits)
        codes = counts.select(F.shiftright(cell, 16).cast("int").alias("piece"), cell.bitwiseAND(0xFFFF).cast("int").alias("at"), F.least(F.lit(255), F.ceil(6 * F.log2("n")) + 1).cast("int").alias("code"))

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                piece, at, code = (np.asarray(c) for c in b.columns)
                for k in np.unique(piece).tolist():
                    own = piece == k
                    np.maximum.at(held.setdefault(k, np.zeros(1 << 16, np.uint8)), at[own], code[own].astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["piece", "codes"])

        self.codes = np.zeros(1 << self.bits, np.uint8)
        if rows:
            for r in codes.repartition("piece").mapInArrow(pieces, "piece int, codes binary").collect():  # at most 2**(MOST_CELLS - 16) pieces
                self.codes[r.piece << 16 : (r.piece + 1) << 16] = np.frombuffer(r.codes, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.codes[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]

    @staticmethod
    def at_most(codes: np.ndarray) -> np.ndarray:
        """The largest count that a code stands for."""
        return np.where(codes > 0, 2.0 ** ((codes.astype(np.float64) - 1) / 6), 0.0)
