"""Files, resumed streams and plans."""

import json

from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import encode, vocab
from dialoom.plans import base
from dialoom.sources import io
from dialoom.streaming import live


def vocabulary_of(spark, words):
    return spark.createDataFrame([(w, k + 4, 1) for k, w in enumerate(words)], "word string, idx int, n bigint")


def test_lines_are_numbered_over_files_and_absent_splits_left_out(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train/a.jsonl").write_text('["a","b"]\n["c","d"]\n')
    (tmp_path / "train/b.jsonl").write_text('["e","f"]\n')
    got = io.read_splits(spark, {"train": f"file://{tmp_path}/train/*", "valid": f"file://{tmp_path}/valid/*"})
    assert [(r.line_no, r.value) for r in got.sort("line_no").collect()] == [(0, '["a","b"]'), (1, '["c","d"]'), (2, '["e","f"]')]


def test_live_encoding_resumes(spark, tmp_path):
    own = io.encoder(vocabulary_of(spark, ["say", "it"]))
    source, target, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    source.mkdir()

    def add(names):
        for n in names:
            (source / f"{n}.jsonl").write_text("".join(json.dumps([{"text": f"say {n}"}, f"it {k}"]) + "\n" for k in range(30)) + "broken\n[1]\n")
        live.live_encode(spark, f"file://{source}", target, state, own, max_files=2, block=7).awaitTermination()
        return spark.read.parquet(target)

    assert add(["a", "b", "c"]).count() == 90
    out = add(["d", "e"])
    assert out.count() == 150 and out.select("file_name", "value").distinct().count() == 150
    first = out.first()
    assert first.x_ref == [4, 3, 2] and [tuple(s) for s in first.steps] == [([4, 3, 2], [5, 3, 2], 1.0)]
    assert max(r["count"] for r in out.groupBy("batch_id", "block").count().collect()) == 7


def test_live_equals_batch(spark, tmp_path):
    lines = [["hello 12345", "wörld ＡＢ"], ["x", "y", "hello"]]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    own = io.encoder(vocabulary_of(spark, ["hello", "ab", "<NUM>"]))
    streamed = live.encoded_lines(spark.read.text(f"file://{tmp_path}/a.jsonl"), own).select(F.explode("steps").alias("s")).select("s.*").collect()
    turns = io.utterances(io.elements(io.read_lines(spark, f"file://{tmp_path}/a.jsonl"))).withColumn("toks", T.tokens(F.col("text")))
    batch = encode.steps(encode.token_ids(turns, vocabulary_of(spark, ["hello", "ab", "<NUM>"]))).select("x_t", "target", "gate").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def test_vocabulary_files(spark, tmp_path):
    v = vocabulary_of(spark, ["b", "a"])
    io.write_vocabulary(v, f"file://{tmp_path}/v")
    doc = json.loads(spark.read.text(f"file://{tmp_path}/v").first()[0])
    assert doc["word2index"] == {"a": 5, "b": 4} and doc["word2count"] == {"a": 1, "b": 1} and doc["index2word"]["0"] == "PAD" and doc["num_words"] == 6
    counts = spark.createDataFrame([("a", 3, 0), ("b", 1, 1)], "word string, n bigint, first_seen bigint")
    io.write_statistics(counts, f"file://{tmp_path}/s")
    assert json.loads(spark.read.text(f"file://{tmp_path}/s").first()[0]) == {"vocab_size": 1, "total_words_processed": 4, "unique_words_found": 2, "min_frequency": 2, "top_10_words": [{"word": "a", "n": 3}, {"word": "b", "n": 1}]}


def test_step_traces_take_numbers_from_names(spark, tmp_path):
    (tmp_path / "detail_trace_3_120.json").write_text(json.dumps([{"t": 0, "loss": 1.5, "topk": [[7, 0.5], [2, 0.25]], "comps": {"ce": 1.0}}, {"t": "speak_1", "loss": 2.0}]))
    a, b = io.read_traces(spark, f"file://{tmp_path}").sort("loss").collect()
    assert (a.t, a.chunk, a.steps, a.topk[0].id, a.comps) == ("0", 3, 120, 7, {"ce": 1.0}) and b.t == "speak_1"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoding_shuffles_once(spark, sf_dir):
    turns = base.turns(spark, sf_dir).withColumn("toks", T.tokens(F.col("text"), normalise=False))
    steps = encode.steps(encode.token_ids(turns, vocabulary_of(spark, ["the"]), bounded=True))
    assert plan_of(steps).count("Exchange hashpartitioning") == 1


def test_counts_use_hash_aggregates(spark, sf_dir):
    counts = vocab.word_counts(base.turns(spark, sf_dir).withColumn("toks", T.tokens(F.col("text"), normalise=False)))
    assert "SortAggregate" not in plan_of(counts) and "HashAggregate" in plan_of(counts)


def test_the_encoder_works_on_flat_arrays_of_any_shape(spark):
    encode = io.encoder(spark.createDataFrame([("a", 4, 1), ("b", 5, 1)], "word string, idx int, n bigint"))
    rows = [([["a", "x", "b"], None, []],), (None,), ([],), ([["b", None]],)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "l array<array<string>>").coalesce(1).select(encode.lines(F.col("l")), encode(F.get("l", F.lit(0)))).collect()]
    assert got == [([[4, 3, 5, 2], [], [2]], [4, 3, 5, 2]), (None, []), ([], []), ([[5, 3, 2]], [5, 3, 2])]
