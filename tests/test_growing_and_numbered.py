"""Streams of files that grow and of numbered chunks: nothing is lost, repeated or out of order over runs."""

import io as bytes_io
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dialoom.sources import io
from dialoom.streaming import live, sources


def own(spark):
    return io.encoder(spark.createDataFrame([("say", 4, 1), ("it", 5, 1)], "word string, idx int, n bigint"))


def line(k):
    return json.dumps([{"text": f"say {k}"}, f"it {k}"]) + "\n"


def test_a_file_that_grows_is_read_on(spark, tmp_path):
    source, target, state = tmp_path / "live.jsonl", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    encode = own(spark)

    def grow(text):
        with open(source, "a") as f:
            f.write(text)
        live.live_encode_growing(spark, f"file://{source}", target, state, encode, block=7).awaitTermination()
        rows = spark.read.parquet(target).collect()
        assert len({r.line_no for r in rows}) == len(rows)
        return {r.line_no: r.value for r in rows}

    whole = [line(k) for k in range(50)]
    assert grow("".join(whole[:20]) + whole[20][:9]).keys() == set(range(20))  # the torn line waits
    got = grow(whole[20][9:] + "broken\n[1]\n" + "".join(whole[21:30]))
    assert got.keys() == {*range(21), *range(23, 32)} and got[23] == whole[21].strip()  # bad lines are numbered
    assert grow("") == got
    assert grow("".join(whole[30:])).keys() == {*range(21), *range(23, 52)}
    assert live.progress(spark, target).collect()[0].next_line == 52
    blocks = spark.read.parquet(target).groupBy("batch_id", "block").count().collect()
    assert max(r["count"] for r in blocks) == 7


def test_start_line_leaves_earlier_lines_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("".join(line(k) for k in range(9)))
    (tmp_path / "in/b.jsonl").write_text("".join(line(k) for k in range(6)))
    live.live_encode_growing(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state", own(spark), start_line=5).awaitTermination()
    assert sorted((r.file_name, r.line_no) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("a.jsonl", 5), ("a.jsonl", 6), ("a.jsonl", 7), ("a.jsonl", 8), ("b.jsonl", 5)]


def test_a_file_that_shrinks_is_an_error(spark, tmp_path):
    source = tmp_path / "a.jsonl"
    source.write_text(line(1) * 5)
    reader = sources.GrowingLines({"path": str(source)}).streamReader(None)
    before = reader.latestOffset()
    source.write_text(line(1))
    with pytest.raises(ValueError, match="whole lines"):
        reader.partitions(before, reader.latestOffset())


@pytest.mark.parametrize("window", [3, 64, 1 << 20])
@pytest.mark.parametrize("block", [1, 5, 17, 1000])
def test_ranges_hold_each_line_once(monkeypatch, block, window):
    monkeypatch.setattr(sources, "WINDOW", window)
    lines = [b"", b"a", b"bb" * 20, b"", b"c\r", "é中".encode() * 9, b"x" * 100, b""]
    data = b"skipped\n" + b"\n".join(lines) + b"\n"
    found = []
    for low in range(8, len(data), block):
        for at, raw in sources._pieces(bytes_io.BytesIO(data), 8, low, min(low + block, len(data))):
            assert data[at : at + len(raw)] == raw and data[at - 1 : at] == b"\n"
            found += raw[:-1].split(b"\n")
    assert found == lines


def test_ranges_of_a_table_of_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\r\ntwo\n\xff\n" * 200 + b"torn")
    sources.register(spark)
    stream = spark.readStream.format("growing_lines").options(path=f"file://{tmp_path}/a.jsonl", blockBytes=100).load()
    stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").sort("byte").collect()
    assert [r.value for r in rows] == ["one", "two", "�"] * 200 and rows[1].byte == 5 and rows[-1].byte == 200 * 11 - 2
    assert len({r.block for r in rows}) > 10


def chunk(folder, number, rows=3):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"pos": pa.array(range(rows), pa.int32()), "x": [f"{number}/{k}" for k in range(rows)]}), folder / f"chunk_{number}.parquet")


def follow(spark, tmp_path, **how):
    """Batches of chunk numbers that a run emits."""
    state, seen = f"file://{tmp_path}/state", []

    def put(rows, batch):
        seen.append((batch, sorted((r.chunk_no, r.pos, r.x, r.more) for r in rows.collect())))

    stream = live.follow_numbered(spark, f"file://{tmp_path}/chunks", "chunk_no int, pos long, x string, more double", state, **how)
    live.drained(stream.writeStream.foreachBatch(put).option("checkpointLocation", state))
    assert all(x == f"{n}/{pos}" and more is None for _, rows in seen for n, pos, x, more in rows)
    return [sorted({n for n, *_ in rows}) for _, rows in sorted(seen) if rows]


def test_chunks_come_in_the_order_of_their_numbers(spark, tmp_path):
    for n in (10, 2, 0, 1):
        chunk(tmp_path / "chunks", n)
    assert follow(spark, tmp_path) == [[0], [1], [2]]  # ten waits
    for n in (9, 8, 7, 6, 5):
        chunk(tmp_path / "chunks", n)
    assert follow(spark, tmp_path) == []
    for n in (11, 3, 4):
        chunk(tmp_path / "chunks", n)
    assert follow(spark, tmp_path, chunks_per_trigger=4) == [[3, 4, 5, 6], [7, 8, 9, 10], [11]]
    assert follow(spark, tmp_path) == []


def test_gaps_can_be_skipped_and_the_first_chunk_set(spark, tmp_path):
    for n in (30, 7, 12, 100):
        chunk(tmp_path / "chunks", n)
    assert follow(spark, tmp_path, gaps="skip", first_chunk=8, chunks_per_trigger=0) == [[12, 30, 100]]


def test_chunks_that_went_and_no_chunks_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no chunks"):
        live.follow_numbered(spark, f"file://{tmp_path}", "x string", "state")
    chunk(tmp_path / "chunks", 0)
    reader = sources.NumberedChunks({"path": str(tmp_path / "chunks")}).streamReader(spark.range(1).schema)
    with pytest.raises(ValueError, match="gone"):
        reader.partitions({"next": 0}, {"next": 2})
    assert [p.number for p in reader.partitions({"next": 0}, {"next": 1})] == [0]


def test_a_stream_that_starts_again_reads_its_checkpoint(tmp_path, spark):
    for n in range(4):
        chunk(tmp_path / "chunks", n)
    log = tmp_path / "state/offsets"
    log.mkdir(parents=True)
    (log / "9").write_text('v1\n{"batchWatermarkMs":0}\n{"next":1}')
    (log / "10").write_text('v1\n{"batchWatermarkMs":0}\n{"next":3}')
    reader = sources.NumberedChunks({"path": str(tmp_path / "chunks"), "checkpoint": f"file://{tmp_path}/state"}).streamReader(spark.range(1).schema)
    assert [reader.latestOffset() for _ in range(2)] == [{"next": 4}, {"next": 4}]


def test_one_line_a_file_is_torn_however_many_there_are(spark, tmp_path):
    from dialoom.plans.feed import _append

    lines = spark.range(25_000).selectExpr("concat('line ', id) AS value", "id AS key", "id >= 24998 AS torn")
    _append(lines, f"file://{tmp_path}/live", 2)
    got = [(tmp_path / f"live/live_{k}.jsonl").read_text() for k in (0, 1)]
    assert got == ["".join(f"line {n}\n" for n in range(k, 24_998, 2)) + "line " for k in (0, 1)]


def test_chunks_are_listed_once_for_many_batches(tmp_path, spark, monkeypatch):
    for n in range(9):
        chunk(tmp_path / "chunks", n)
    calls, listed = [], sources.listed
    monkeypatch.setattr(sources, "listed", lambda p: [calls.append(p), listed(p)][1])
    reader = sources.NumberedChunks({"path": str(tmp_path / "chunks"), "chunksPerTrigger": 2}).streamReader(spark.range(1).schema)
    ends = [0] + [reader.latestOffset()["next"] for _ in range(5)]
    assert ends == [0, 2, 4, 6, 8, 9]
    assert [len(reader.partitions({"next": a}, {"next": b})) for a, b in zip(ends, ends[1:])] == [2, 2, 2, 2, 1] and len(calls) == 2
    (tmp_path / "chunks/chunk_3.parquet").unlink()
    with pytest.raises(ValueError, match="gone"):
        reader.partitions({"next": 2}, {"next": 4})


def test_a_batch_does_not_go_through_all_chunks(tmp_path, spark):
    class Held(dict):
        def __iter__(self):
            raise AssertionError("all chunks")

    for n in range(9):
        chunk(tmp_path / "chunks", n)
    reader = sources.NumberedChunks({"path": str(tmp_path / "chunks"), "chunksPerTrigger": 2}).streamReader(spark.range(1).schema)
    assert reader.latestOffset() == {"next": 2}
    reader.held = Held(reader.held)
    assert reader.latestOffset() == {"next": 4} and [p.number for p in reader.partitions({"next": 1}, {"next": 4})] == [1, 2, 3]


def test_small_chunks_share_tasks(tmp_path, spark):
    for n in range(5):
        chunk(tmp_path / "chunks", n)
    tasks = []
    stream = live.follow_numbered(spark, f"file://{tmp_path}/chunks", "chunk_no int, x string", f"file://{tmp_path}/state", chunks_per_trigger=4)
    live.drained(stream.writeStream.foreachBatch(lambda rows, batch: tasks.append((rows.rdd.getNumPartitions(), [r.x for r in rows.collect()]))), f"file://{tmp_path}/state")
    assert tasks == [(1, [f"{n}/{k}" for n in range(4) for k in range(3)]), (1, ["4/0", "4/1", "4/2"])]
    options = {"path": str(tmp_path / "chunks"), "taskBytes": 3 * sources.OPENING}
    own = sources.NumberedChunks(options).streamReader(spark.range(1).schema).partitions({"next": 0}, {"next": 5})
    assert [[n for n, _ in p.files] for p in own] == [[0, 1, 2], [3, 4]]


def test_small_files_are_written_as_partition_by_does(tmp_path, spark):
    rows = spark.range(25_000).selectExpr("id div 7 AS k", "id", "if(id % 3 = 0, null, concat('x', id)) AS x").repartition(3, "k").sortWithinPartitions("k")
    io.write_small(rows.where("k % 2 = 0"), f"file://{tmp_path}/a", "k")
    io.write_small(rows.where("k % 2 = 1"), f"file://{tmp_path}/a", "k")
    rows.write.partitionBy("k").parquet(f"file://{tmp_path}/b")
    a, b = (spark.read.schema("k long, id long, x string").parquet(f"file://{tmp_path}/{x}") for x in "ab")
    assert a.count() == 25_000 and a.exceptAll(b).isEmpty()
    files = [p for p in (tmp_path / "a").rglob("*") if p.is_file()]
    assert len(files) == 3572 and all(p.name.startswith("part-") for p in files)
    with pytest.raises(Exception, match="k is null"):
        io.write_small(spark.range(1).selectExpr("cast(null AS long) AS k", "id"), f"file://{tmp_path}/c", "k")
