"""Merges with a manifest: damaged files, breaks, and what comes later."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dialoom.sources import merge

SCHEMA = "pos int, x string"


def chunk(folder, number, rows=3, **columns):
    table = pa.table({"pos": pa.array(range(rows), pa.int32()), "x": [f"{number}/{k}" for k in range(rows)]} | columns)
    pq.write_table(table, folder / f"chunk_{number}.parquet")


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    for n in (0, 1, 2, 9, 10, 11):
        chunk(folder, n)
    (folder / "notes.txt").write_text("no chunk")
    return folder


def rows_of(spark, target):
    return sorted((r.chunk_no, r.pos, r.x) for r in merge.read_merged(spark, target, SCHEMA).collect())


def rows_for(*numbers):
    return [(n, k, f"{n}/{k}") for n in sorted(numbers) for k in range(3)]


def spoil(path, keep):
    """A chunk whose bytes are cut or changed inside a page."""
    data = path.read_bytes()
    at = data.find(b"/1")
    path.write_bytes(data[: len(data) // 2] if keep == "half" else b"" if keep == "nothing" else data[: at - 40] + b"\xff" * 60 + data[at + 20 :])


@pytest.mark.parametrize("how", ["half", "nothing", "page"])
def test_damaged_chunks_are_listed_or_end_the_merge(spark, source, tmp_path, how):
    spoil(source / "chunk_9.parquet", how)
    pq.write_table(pa.table({"other": [1]}), source / "chunk_12.parquet")
    target = f"file://{tmp_path}/merged"
    with pytest.raises(ValueError, match="2 damaged chunks"):
        merge.merge(spark, f"file://{source}", target, SCHEMA)
    assert rows_of(spark, target) == [] and merge.manifest(spark, target).count() == 0
    merge.merge(spark, f"file://{source}", target, SCHEMA, on_corrupt="skip", commit=2)
    assert rows_of(spark, target) == rows_for(0, 1, 2, 10, 11)
    bad = {r.chunk_no: r.error for r in merge.damaged(spark, target).collect()}
    assert bad.keys() == {9, 12} and "pos, x lack" in bad[12]
    assert {r.chunk_no: r.rows for r in merge.manifest(spark, target).where("error is null").collect()} == dict.fromkeys((0, 1, 2, 10, 11), 3)


def test_a_merge_that_broke_off_goes_on(spark, source, tmp_path, monkeypatch):
    target, whole, seen = f"file://{tmp_path}/merged", merge._committed, []

    def breaking(spark, files, *how):
        seen.append(sorted(files.chunk_no))
        if len(seen) == 2:  # rows are there, in part, and the manifest isn't
            spark.read.schema(SCHEMA).parquet(files.path.iloc[0]).selectExpr("*", "-1L as chunk_no").write.parquet(f"{target}/data/commit={how[-1]}")
            raise InterruptedError
        whole(spark, files, *how)

    monkeypatch.setattr(merge, "_committed", breaking)
    with pytest.raises(InterruptedError):
        merge.merge(spark, f"file://{source}", target, SCHEMA, commit=3)
    assert rows_of(spark, target) == rows_for(0, 1, 2)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "merged/data/commit=0").glob("*.parquet")}
    assert merge.merge(spark, f"file://{source}", target, SCHEMA, commit=3) == 1  # 9, 10 and 11 are one run
    assert seen == [[0, 1, 2], [9, 10, 11], [9, 10, 11]] and rows_of(spark, target) == rows_for(0, 1, 2, 9, 10, 11)
    assert kept == {p: p.stat().st_mtime_ns for p in (tmp_path / "merged/data/commit=0").glob("*.parquet")}
    assert merge.merge(spark, f"file://{source}", target, SCHEMA, commit=3) == 0


def test_chunks_that_come_or_are_mended_later(spark, source, tmp_path):
    target = f"file://{tmp_path}/merged"
    spoil(source / "chunk_1.parquet", "half")
    merge.merge(spark, f"file://{source}", target, SCHEMA, on_corrupt="skip", commit=4)
    chunk(source, 1)
    chunk(source, 5)
    chunk(source, 40)
    merge.merge(spark, f"file://{source}", target, SCHEMA, on_corrupt="fail", commit=4)
    assert rows_of(spark, target) == rows_for(0, 1, 2, 5, 9, 10, 11, 40)
    chunk(source, 40, rows=9)
    with pytest.raises(ValueError, match="changed"):
        merge.merge(spark, f"file://{source}", target, SCHEMA)


def test_start_order_and_digests(spark, source, tmp_path):
    target = f"file://{tmp_path}/merged"
    assert merge.merge(spark, f"file://{source}", target, SCHEMA, start_chunk=2, commit=100) == 1
    files = sorted((tmp_path / "merged/data/commit=0").glob("part-*.parquet"))
    stored = [r for f in files for r in pq.read_table(f).to_pylist()]
    assert [(r["chunk_no"], r["pos"]) for r in stored] == [(n, k) for n, k, _ in rows_for(2, 9, 10, 11)]  # ten after nine
    digests = [r.digest for r in merge.manifest(spark, target).collect()]
    assert len(set(digests)) == 4 and all(len(d) == 64 for d in digests)
    with pytest.raises(ValueError):
        merge.merge(spark, f"file://{source}", target, SCHEMA, on_corrupt="ask")


def test_many_small_runs_take_few_jobs(spark, source, tmp_path, monkeypatch):
    for n in range(20, 58):
        chunk(source, n)
    spoil(source / "chunk_30.parquet", "half")
    (tmp_path / "merged/data/commit=40").mkdir(parents=True)  # left by a run that broke off
    chunk(tmp_path / "merged/data/commit=40", 7)
    target, whole, waves = f"file://{tmp_path}/merged", merge._committed, []
    monkeypatch.setattr(merge, "_committed", lambda spark, files, *how: [waves.append(sorted(files.chunk_no)), whole(spark, files, *how)])
    assert merge.merge(spark, f"file://{source}", target, SCHEMA, on_corrupt="skip", commit=1) == 44
    assert [len(w) for w in waves] == [1, 2, 4, 8, 16, 13] and sum(waves, []) == [0, 1, 2, 9, 10, 11, *range(20, 58)]
    numbers = {n for w in waves for n in w} - {30}
    assert rows_of(spark, target) == rows_for(*numbers)
    assert {(r.chunk_no, r.commit, r.rows) for r in merge.manifest(spark, target).collect()} == {(n, n, 3) for n in numbers} | {(30, 30, None)}
    monkeypatch.setattr(merge, "WAVE_FILES", 2)
    waves.clear()
    for n in range(60, 66):
        chunk(source, n, rows=0 if n == 62 else 3)
    assert merge.merge(spark, f"file://{source}", target, SCHEMA, on_corrupt="skip", commit=1, most_runs=5) == 5
    assert max(len(w) for w in waves) == 2 and rows_of(spark, target) == rows_for(*numbers, 60, 61, 63, 64)
