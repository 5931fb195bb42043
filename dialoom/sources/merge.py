"""Merging numbered chunks into one store, with a manifest: damaged chunks are listed, and a merge that broke off goes on.

A merge first checks the chunk files in tasks: the footer, and (`deep`) every page, and takes a digest of the bytes. Then
it commits runs of consecutive chunk numbers: the rows of a run are written to `data/commit=<first number>` and after
that the run's manifest, one row a chunk file (chunk_no, path, bytes, rows, digest, error). What has no manifest
doesn't count: a run that broke off is written again, over itself. A merge that starts again leaves out all files that
the manifest has with the same size; of a file that has changed since, that is an error.

The first run is written alone, then twice as many together each time, up to WAVE_BYTES or WAVE_FILES: a merge of many
small runs takes few Spark jobs, and one that breaks off loses no more than about what it had done before.

The driver holds the names and sizes of the chunk files that are still to do, as any reader of them would."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dialoom.sources.io import exists
from dialoom.sources.shared import listed, opened

CHUNK_RE = r"(?:^|/)chunk(?:_no=|_)(\d+)(?=[./])"
MANIFEST = "chunk_no bigint, path string, bytes bigint, rows bigint, digest string, error string"
COMMIT = 100
#: What runs that are written together may have in all; one run may have more.
WAVE_BYTES, WAVE_FILES = 1 << 30, 8192


def chunk_files(spark: SparkSession, source: str) -> DataFrame:
    """(chunk_no, path, bytes) of the files under a folder whose names give a chunk number; contents aren't read."""
    found = [(int(hit[1]), path, size) for path, size in sorted(listed(source).items()) if (hit := re.search(CHUNK_RE, path))]  # Spark's listing leaves empty files out
    return spark.createDataFrame(found, "chunk_no bigint, path string, bytes bigint")


def checked(files: DataFrame, deep: bool = True, names: list[str] | None = None) -> DataFrame:
    """files (chunk_no, path, bytes) with rows, digest (SHA-256 of the bytes) and error: what keeps a file from being
    read, else null. names: columns that a file has to have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_check(path, deep, names) for path in b.column("path").to_pylist()]
            rows, digest, error = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.int64()), pa.array(digest, pa.string()), pa.array(error, pa.string())], [*b.schema.names, "rows", "digest", "error"])

    spread = files.repartition(F.col("path"))  # a row is a whole file's work
    return spread.select("chunk_no", "path", "bytes").mapInArrow(run, MANIFEST)


def _check(path: str, deep: bool, names: list[str] | None) -> tuple[int | None, str | None, str | None]:
    digest = None
    try:
        system, inside = opened(path)
        with system.open_input_file(inside) as f:
            sha = hashlib.sha256()
            while piece := f.read(1 << 20):
                sha.update(piece)
            digest = sha.hexdigest()
        with system.open_input_file(inside) as f:
            file = pq.ParquetFile(f)
            lost = [n for n in names or [] if n not in file.schema_arrow.names]
            if lost:
                return None, digest, f"columns {', '.join(lost)} lack"
            if deep:
                for _ in file.iter_batches(batch_size=8192):
                    pass
            return file.metadata.num_rows, digest, None
    except Exception as e:  # whatever is wrong with a file is a result
        return None, digest, f"{type(e).__name__}: {e}"[:500]


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """(chunk_no, path, bytes, rows, digest, error, commit) of what a merge has done so far."""
    folder = f"{target}/_manifest"
    if not exists(spark, folder):
        return spark.createDataFrame([], MANIFEST + ", commit bigint")
    return spark.read.schema(MANIFEST + ", commit bigint").parquet(folder)


def damaged(spark: SparkSession, target: str) -> DataFrame:
    """(chunk_no, path, error) of the files that the merge left out."""
    return manifest(spark, target).where("error is not null").select("chunk_no", "path", "error")


def merge(spark: SparkSession, source: str, target: str, schema: str, order: str = "pos", on_corrupt: str = "fail", start_chunk: int = 0, commit: int = COMMIT, deep: bool = True, most_runs: int | None = None) -> int:
    """Merge the chunks of a folder into `target`; the number of runs that were committed. schema: of the chunks (DDL,
    without chunk_no, which the file's name gives). Damaged files end the merge before anything is written ('fail') or
    are left out and listed ('skip'). `commit` consecutive chunk numbers go together, in the order of number and `order`; most_runs: leave the rest to the
    next call."""
    if on_corrupt not in ("fail", "skip"):
        raise ValueError("on_corrupt is 'fail' or 'skip'")
    done = manifest(spark, target).select(F.col("path").alias("_path"), F.col("bytes").alias("_bytes"), F.col("error").isNull().alias("_good"))
    files = chunk_files(spark, source).where(F.col("chunk_no") >= start_chunk)
    known = files.join(done, F.col("path") == F.col("_path"))
    changed = known.where((F.col("bytes") != F.col("_bytes")) & F.col("_good")).select("path").take(5)
    if changed:
        raise ValueError(f"chunks that were merged have changed: {[r.path for r in changed]}")
    same = F.col("bytes") == F.col("_bytes")  # a damaged file that was mended is tried again
    todo = files.join(done, (F.col("path") == F.col("_path")) & same, "left_anti")
    found = checked(todo, deep, StructType.fromDDL(schema).names).toPandas().sort_values(["chunk_no", "path"])  # a row a file
    bad = found[found.error.notna()]
    if on_corrupt == "fail" and len(bad):
        raise ValueError(f"{len(bad)} damaged chunks, such as {bad.path.iloc[0]}: {bad.error.iloc[0]}")
    last = manifest(spark, target).agg(F.coalesce(F.max("commit"), F.lit(-1))).first()[0]
    commits = []
    for number in sorted(set(found.chunk_no // commit))[:most_runs]:
        last = max(int(number), last + 1)  # a run never takes another's place
        commits.append((int(number), last))
    found["commit"] = (found.chunk_no // commit).map(dict(commits))
    found = found[found.commit.notna()].astype({"commit": "int64"})
    runs = found.groupby("commit").agg(size=("bytes", "sum"), files=("path", "count"))
    wave, together, double = [], 1, "commit" not in StructType.fromDDL(schema).names  # rows with a column of that name go run by run
    for run in runs.itertuples():
        size, files = (sum(x) for x in zip((run.size, run.files), *((r.size, r.files) for r in wave)))
        if wave and (len(wave) == together or size > WAVE_BYTES or files > WAVE_FILES):
            _committed(spark, found[found.commit.isin([r.Index for r in wave])], target, schema, order, commit, wave[0].Index)
            wave, together = [], together * 2 if double else 1
        wave.append(run)
    if wave:
        _committed(spark, found[found.commit.isin([r.Index for r in wave])], target, schema, order, commit, wave[0].Index)
    return len(runs)


def _committed(spark: SparkSession, files, target: str, schema: str, order: str, width: int, first: int) -> None:
    """Write the runs of a wave, of which `first` is the first one: all their rows, then all their manifests. files: those of
    `checked`, with the number of their run as commit; width: chunk numbers a run."""
    runs = sorted(set(zip((files.chunk_no // width).tolist(), files.commit.tolist())))
    system, root = opened(target)
    for _, commit in runs:  # what a run that broke off has left
        for left in (f"{root}/data/commit={commit}", f"{root}/_manifest/commit={commit}"):
            if system.get_file_info(left).type.name == "Directory":
                system.delete_dir(left)
    good = files[files.error.isna()]
    if len(good):
        number = F.regexp_extract(F.col("_metadata.file_path"), CHUNK_RE, 1).cast("long")
        of = F.broadcast(spark.createDataFrame(runs, "_run bigint, commit bigint"))  # a row a run
        rows = spark.read.schema(schema).parquet(*good.path).withColumn("chunk_no", number)
        if len(runs) == 1:
            rows.repartitionByRange("chunk_no", order).sortWithinPartitions("chunk_no", order).write.parquet(f"{target}/data/commit={first}")
        else:
            keys = ["commit", "chunk_no", order]
            rows = rows.withColumn("_run", F.floor(F.col("chunk_no") / width)).join(of, "_run").drop("_run")
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append").partitionBy("commit").parquet(f"{target}/data")
    noted = [(int(r.chunk_no), r.path, int(r.bytes), None if r.rows != r.rows else int(r.rows), r.digest, r.error, r.commit) for r in files.itertuples()]
    spark.createDataFrame(noted, MANIFEST + ", commit bigint").coalesce(1).write.mode("append").partitionBy("commit").parquet(f"{target}/_manifest")


def read_merged(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The rows of all runs that the manifest has, with chunk_no."""
    commits = [r[0] for r in manifest(spark, target).where("error is null and rows > 0").select("commit").distinct().collect()]
    whole = f"{schema}, chunk_no bigint"
    if not commits:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(*(f"{target}/data/commit={c}" for c in sorted(commits)))
