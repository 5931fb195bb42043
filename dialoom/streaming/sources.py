"""Streaming sources that Spark's file source has no form for: files that grow, and chunks in the order of their numbers.

Both are Python data sources. What the driver holds is one offset; tasks read byte ranges or chunk files themselves, as
Arrow batches. Offsets stand in Spark's checkpoint, so a batch that failed is read again from the same ranges."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from dialoom.sources.shared import listed, opened

#: Files that one offset may name; folders of more hold closed files, which Spark's own source reads.
MOST_FILES = 10_000
BLOCK, WINDOW, TAIL = 64 << 20, 4 << 20, 1 << 16
#: What opening a file counts as, where tasks are given files by their bytes.
OPENING = 1 << 20
CHUNK_RE = re.compile(r"(?:^|/)chunk(?:_no=|_)(\d+)(?=[./])")


class GrowingLines(DataSource):
    """Whole lines of a file, or of all files of a folder, that others append to: (file_path, block, byte, value), where
    block is the start of the range that a task read, and byte the line's place. A line without its line feed waits
    until it is finished. The offset is how far each file has been read; a file that shrank is an error.

    Options: path; blockBytes, the most that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file_path string, block bigint, byte bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GrowingReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, low: int, high: int):
        self.path, self.first, self.low, self.high = path, first, low, high


class _GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("blockBytes", BLOCK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        if len(files) > MOST_FILES:
            raise ValueError(f"{len(files)} files under {self.path}; more than {MOST_FILES} need the text source")
        return {p: end for p, size in sorted(files.items()) if (end := _last_line_end(p, size))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, high in end.items():
            low = start.get(path, 0)
            if high < low:
                raise ValueError(f"{path} has {high} bytes of whole lines, of which {low} had been read")
            out += [_Range(path, low, at, min(at + self.block, high)) for at in range(low, high, self.block)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, inside = opened(partition.path)
        with system.open_input_file(inside) as f:
            for at, raw in _pieces(f, partition.first, partition.low, partition.high):
                lines = raw[:-1].split(b"\n")
                places, values = [], []
                for line in lines:
                    places.append(at)
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([partition.low] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(values, pa.string())], ["file_path", "block", "byte", "value"])


def _last_line_end(path: str, size: int) -> int:
    """Bytes up to the last line feed."""
    system, inside = opened(path)
    with system.open_input_file(inside) as f:
        while size > 0:
            low = max(0, size - TAIL)
            f.seek(low)
            at = f.read(size - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
    return 0


def _pieces(f, first: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(place, whole lines) of the lines that start in [low, high); first: a place where a line surely starts."""
    at = low
    if low > first:  # the line that reaches in from before belongs to the range where it starts
        at = low - 1
        f.seek(at)
        while True:
            data = f.read(WINDOW)
            cut = data.find(b"\n")
            if cut >= 0 or not data:
                at += cut + 1 if cut >= 0 else 0
                break
            at += len(data)
        if at >= high or not data:
            return
    f.seek(at)
    held, read = b"", at
    while at < high:
        data = f.read(min(WINDOW, high - read) if read < high else WINDOW)
        if not data:
            return
        read += len(data)
        held += data
        cut = held.rfind(b"\n") + 1 if read <= high else held.find(b"\n", max(0, high - 1 - at)) + 1
        if cut:
            yield at, held[:cut]
            at, held = at + cut, held[cut:]


class NumberedChunks(DataSource):
    """Rows of Parquet chunks in the order of their numbers, which names like chunk_12.parquet or chunk_no=12/... give;
    a column chunk_no of the schema is the number. The offset is the number of the next chunk.

    Options: path; chunksPerTrigger (1; 0: all there are); firstChunk (0); gaps: `wait` (a number that lacks holds back
    all later ones until it comes) or `skip` (what is there goes on in order; a chunk that comes too late is never
    read); checkpoint: the query's checkpoint, from which a query that starts again learns where it was; taskBytes: files
    of a batch that a task reads one after the other, up to so many bytes (0: a task a file). Chunks have to be moved into
    place whole, as Spark and most writers do."""

    @classmethod
    def name(cls) -> str:
        return "numbered_chunks"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChunkReader(self.options, schema)


class _Chunk(InputPartition):
    """A file of a chunk, and those (number, path) that the same task reads after it."""

    def __init__(self, number: int, path: str):
        self.number, self.files = number, [(number, path)]


class _ChunkReader(DataSourceStreamReader):
    def __init__(self, options, schema):
        self.path, self.checkpoint, self.schema = options["path"], options.get("checkpoint"), to_arrow_schema(schema)
        self.most, self.first, self.skips = int(options.get("chunksPerTrigger", 1)), int(options.get("firstChunk", 0)), options.get("gaps", "wait") == "skip"
        self.bytes = int(options.get("taskBytes", 0))
        self.next: int | None = None
        self.held: dict[int, dict[str, int]] = {}
        self.order: list[int] = []

    def _list(self) -> None:
        found: dict[int, dict[str, int]] = {}
        for path, size in listed(self.path).items():
            if hit := CHUNK_RE.search(path):
                found.setdefault(int(hit[1]), {})[path] = size
        self.held, self.order = found, sorted(found)

    def _hold(self, numbers: range) -> None:
        """Lists the folder, unless these numbers were all there when it was listed last and still are: a folder of many
        chunks is neither listed nor gone through for every few of them."""
        if numbers and all(n in self.held for n in numbers):
            own = [p for n in numbers for p in self.held[n]]
            system = opened(own[0])[0]
            if all(x.type == fs.FileType.File for x in system.get_file_info([opened(p)[1] for p in own])):
                return
        self._list()

    def _planned(self) -> int:
        """Where the last batch of the checkpoint ends: the last line of the newest file of its offset log."""
        logs = {int(p.rsplit("/", 1)[1]): p for p in listed(f"{self.checkpoint}/offsets") if p.rsplit("/", 1)[1].isdigit()} if self.checkpoint else {}
        if not logs:
            return self.first
        system, inside = opened(logs[max(logs)])
        with system.open_input_file(inside) as f:
            return json.loads(f.read().splitlines()[-1])["next"]

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        at = self._planned() if self.next is None else self.next
        self._hold(range(at, at + self.most))
        low = bisect_left(self.order, at)
        ahead = self.order[low : low + self.most if self.most else None]
        if not self.skips:
            ahead = [n for k, n in enumerate(ahead) if n == at + k]
        if ahead:
            at = ahead[-1] + 1
        self.next = at
        return {"next": at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        numbers = range(start["next"], end["next"])
        self._hold(numbers)
        if not self.skips and (lost := [n for n in numbers if n not in self.held]):
            raise ValueError(f"chunks {lost[:5]} under {self.path} are gone")
        out, room = [], 0
        for n in self.order[bisect_left(self.order, numbers.start) : bisect_left(self.order, numbers.stop)]:
            for path, size in sorted(self.held[n].items()):
                cost = max(size, OPENING)
                if cost <= room:
                    out[-1].files.append((n, path))
                else:
                    out.append(_Chunk(n, path))
                    room = self.bytes
                room -= cost
        return out

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        for number, path in partition.files:
            system, inside = opened(path)
            with system.open_input_file(inside) as f:
                file = pq.ParquetFile(f)
                own = set(file.schema_arrow.names)
                for b in file.iter_batches(batch_size=8192, columns=[n for n in self.schema.names if n in own]):
                    columns = [b.column(x.name).cast(x.type) if x.name in own else pa.array([number] * b.num_rows, x.type) if x.name == "chunk_no" else pa.nulls(b.num_rows, x.type) for x in self.schema]
                    yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def register(spark: SparkSession) -> None:
    for source in (GrowingLines, NumberedChunks):
        spark.dataSource.register(source)
