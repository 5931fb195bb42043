"""Forms of the operators for large tables, against plain Python and by their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dialoom.functions import arrays as A
from dialoom.functions import text as T
from dialoom.operators import batches, chunks, encode, scoring, vocab
from dialoom.sources import io
from dialoom.streaming import live


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- running sums
@pytest.mark.parametrize("wide", [1, 3, 4096])
def test_sums_before(spark, monkeypatch, wide):
    monkeypatch.setattr(chunks, "WIDE", wide)
    rng = random.Random(8)
    rows = [(s, k, rng.randrange(5)) for s in (0, 1, 2) for k in rng.sample(range(-50, 200), 40)]
    d = spark.createDataFrame(rows, "split_ord int, b long, n long")
    got = {(r.split_ord, r.b): r.total for r in chunks.sums_before(d, ["split_ord", "b"], "n", "total").collect()}
    total = 0
    for s, b, n in sorted(rows):
        assert got[s, b] == total
        total += n
    restarted = {(r.split_ord, r.b): r.total for r in chunks.sums_before(d, ["split_ord", "b"], "n", "total", within=1).collect()}
    for s, b, _ in rows:
        assert restarted[s, b] == sum(n for s2, b2, n in rows if s2 == s and b2 < b)


def test_only_sums_of_sums_meet_in_one_window(spark):
    d = spark.range(100).select((F.col("id") % 3).alias("split_ord"), F.col("id").alias("conv_id"))
    plan = chunks.dense_ordinal(d, "split_ord", "conv_id", bucket=[F.col("split_ord"), F.floor(F.col("conv_id") / 8)])._jdf.queryExecution().optimizedPlan().toString()
    specs = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"(\w+\([^()]*\)) windowspecdefinition\((.*?) ASC", plan) for x in [" ".join(x)]]
    assert sorted(specs) == ["row_number() _b0, _b1, split_ord", "sum(_sum) _b0"]  # ordered by _b0 and the wide key: over all, a row for WIDE buckets


def test_ordinals_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(chunks, "WIDE", 4)
    d = spark.range(500).select((F.col("id") % 3).cast("int").alias("split_ord"), ((F.col("id") * 7919) % 10_007 - 5000).alias("conv_id"))
    got = chunks.dense_ordinal(d, "split_ord", "conv_id", bucket=[F.col("split_ord"), F.floor(F.col("conv_id") / 64)]).collect()
    assert [r.ordinal for r in sorted(got, key=lambda r: (r.split_ord, r.conv_id))] == list(range(500))


# ---- words
def test_places_of_any_64_bits(spark):
    ids = [-(2**63), -(2**62) - 1, -5, 0, 9, 2**61 + 9, 2**62 + 5, 2**63 - 1]
    rows = [(s, i, t, [f"{s} {i} {t} 0", f"{s} {i} {t} 1"]) for s in (0, 1, 2) for i in ids for t in (-3, 0, 2**31 - 1)]
    random.Random(1).shuffle(rows)
    got = vocab.word_counts(spark.createDataFrame(rows, "split_ord int, conv_id long, turn int, toks array<string>")).sort("first_seen").collect()
    assert [r.word for r in got] == [w for r in sorted(rows) for w in r[3]]


def test_a_second_trim_changes_nothing(spark):
    v = spark.createDataFrame([("a", 4, 5), ("b", 5, 1), ("c", 6, 2)], "word string, idx int, n bigint")
    once = vocab.trimmed(v, 2)
    assert [tuple(r) for r in vocab.trimmed(once, 2).sort("idx").collect()] == [("a", 4, 1, True), ("c", 5, 1, True)]
    assert vocab.trimmed(once, 99).count() == 2


def test_sketches_unite(spark):
    d = spark.range(3000).select((F.col("id") % 2).alias("run"), (F.col("id") % 7).alias("part"), F.array(F.concat(F.lit("w"), (F.col("id") % 2000).cast("string"))).alias("toks"))
    parts = vocab.sketches(d.where("run = 0"), "run", "part").unionByName(vocab.sketches(d.where("run = 1"), "run", "part"))
    total = vocab.distinct_words(parts.withColumn("all", F.lit(1)), "all").first()
    assert abs(total.distinct_words - 2000) <= 40 and total.tokens == 3000


def test_lookup_by_file(spark, tmp_path):
    rows = [("train", i, t, None if (i + t) % 9 == 0 else [f"w{(i * j) % 13}" for j in range(t)]) for i in range(40) for t in range(4)] + [("valid", 99, 0, ["none", "of", "these"])]
    schema = "split string, conv_id long, turn int, toks array<string>"
    spark.createDataFrame(rows, schema).repartition(6, "conv_id").write.parquet(f"file://{tmp_path}/turns")
    turns = spark.read.schema(schema).parquet(f"file://{tmp_path}/turns")
    words = spark.createDataFrame([(f"w{k}", k + 4) for k in range(0, 13, 2)], "word string, idx int")
    found = encode.token_ids(turns, words, store=f"file://{tmp_path}/dictionaries", most=1)
    want = {(s, i, t): [*((int(w[1:]) + 4 if w[0] == "w" and w[1:].isdigit() and int(w[1:]) % 2 == 0 else 3) for w in toks or []), 2] for s, i, t, toks in rows}
    assert {(r.split, r.conv_id, r.turn): r.ids for r in found.collect()} == want and found.count() == len(rows)
    assert "Exchange" not in plan_of(found)
    assert encode.token_ids(turns, words, store="unused").count() == len(rows)  # a small vocabulary is broadcast


@pytest.mark.parametrize("at_once", [1, 7, 10_000])
def test_lookup_by_file_in_pieces(spark, tmp_path, at_once):
    rows = [("train", i, 0, None if i % 5 == 0 else [f"w{(i * j) % 9}" for j in range(i % 23)]) for i in range(60)]
    schema = "split string, conv_id long, turn int, toks array<string>"
    spark.createDataFrame(rows, schema).repartition(3, "conv_id").write.parquet(f"file://{tmp_path}/turns")
    turns = spark.read.schema(schema).parquet(f"file://{tmp_path}/turns")
    words = spark.createDataFrame([(f"w{k}", k + 4) for k in range(1, 9)], "word string, idx int")
    found = encode.token_ids_by_file(turns, words, f"file://{tmp_path}/dictionaries", at_once=at_once)
    assert {r.conv_id: r.ids for r in found.collect()} == {i: [*(3 if w == "w0" else int(w[1:]) + 4 for w in toks or []), 2] for _, i, _, toks in rows}


# ---- samples
@pytest.mark.parametrize("width", [1, 16, 1 << 52])
def test_quotas_are_exact(spark, width):
    rng = random.Random(9)
    rows = [(c, k, rng.randrange(30)) for c, n in (("a", 90), ("b", 3), (None, 40), ("d", 0)) for k in range(n)]
    d = spark.createDataFrame(rows, "class string, id int, o long").where("class is not null")
    got = batches.quota(d, 17, "class", key=F.col("id"), order=F.col("o"), width=width).collect()
    for c in ("a", "b"):
        want = sorted((o, k) for x, k, o in rows if x == c)[:17]
        assert sorted((r.o, r.id) for r in got if r["class"] == c) == want
    hashed = lambda: sorted(r.id for r in batches.quota(d, 17, "class", key=F.col("id")).where("class = 'a'").collect())
    assert len(hashed()) == 17 and hashed() == hashed()
    sized = spark.createDataFrame([("a", 5), ("d", 9)], "class string, quota int")
    assert [r["class"] for r in batches.quota(d, sized, "class", key=F.col("id")).collect()] == ["a"] * 5


def test_short_targets_are_sampled(spark):
    steps = spark.range(200).select(F.col("id").alias("conv_id"), F.lit(0).alias("step"), F.when(F.col("id") % 4 == 0, F.array(F.lit(5), F.lit(6))).otherwise(F.array(F.lit(5), F.lit(0))).alias("target"))
    size = lambda **how: batches.short_targets(steps, 2, key=F.col("conv_id"), **how).count()
    assert (size(), size(keep=10), size(keep_share=0.5), size(keep=1000), size(keep=0)) == (50, 60, 125, 200, 50)
    assert batches.short_targets(steps, 2, key=F.col("conv_id"), keep=10).columns == steps.columns


def test_shuffled_chunks(spark):
    d = spark.range(100).select((F.col("id") / 10).cast("int").alias("chunk_no"), "id")
    one, two, other = (chunks.shuffled(d, F.col("id"), seed=s).collect() for s in (1, 1, 2))
    assert one == two and one != other and [r.chunk_no for r in one] == sorted(r.chunk_no for r in one)
    assert all(sorted(r.place for r in one if r.chunk_no == c) == list(range(10)) for c in range(10))


# ---- steps
def test_rendered_forced_rows(spark):
    schema = "conv_id long, step int, x_ref array<int>, x_t array<int>, target array<int>"
    s = spark.createDataFrame([(1, 0, [4, 2], [5, 2], [16, 0, 7, 30000, 2]), (1, 1, [4, 2], None, [2]), (2, 0, [0], [0, 0], [9, 2]), (3, 0, [4], [5], [0, 0]), (3, 1, [4], [5], None)], schema)
    out = batches.forced_rendered(s)
    want = {(r.conv_id, r.step, r.j): (" ".join(map(str, r.context)), r.prefix and " ".join(map(str, r.prefix)), r.gold) for r in batches.forced(s).collect()}
    assert {(r.conv_id, r.step, r.j): (r.context, r.prefix, r.gold) for r in out.collect()} == want and out.count() == 7
    assert want[1, 0, 3] == ("5 2", "16 7 30000", 2) and want[2, 0, 0] == ("1 2", None, 9)
    plan = plan_of(out)
    assert "transform(" not in plan[: plan.index("Generate")]  # nothing is rendered a row


def test_forced_places_hold_each_target_once(spark):
    s = spark.createDataFrame([(1, 0, [4], [5], [6, 7, 0, 2]), (2, 0, [4], None, [0])], "conv_id long, step int, x_ref array<int>, x_t array<int>, target array<int>")
    (row,) = batches.forced_places(s).collect()
    assert (row.context, row.target, row.places) == ([5], [6, 7, 2], [0, 1, 2])
    cut = batches.forced_places(s).select(F.transform("places", lambda j: batches.prefix_at(F.col("target"), j)).alias("p")).first().p
    assert cut == [None, [6], [6, 7]]


def test_plans_to_the_most_steps(spark):
    s = spark.createDataFrame([(1, 0, [5, 2]), (1, 1, [6, 2]), (2, 0, [0])], "conv_id long, step int, target array<int>")
    got = {(r.conv_id, r.step): r.target for r in batches.extended(s, 1, 4, to_most=True, safety=4).collect()}
    assert got == {(1, 0): [5, 2], (1, 1): [6, 2], (1, 2): None, (1, 3): [6, 2], (2, 0): [0], (2, 1): None, (2, 2): None, (2, 3): None}
    assert batches.extended(s, 3, 4, to_most=False).where("conv_id = 2").count() == 3


def test_answers(spark):
    rows = [(1, 1, 0.9, 7), (1, 2, 0.8, 5), (2, 1, 0.1, 5), (2, 2, 0.2, 2), (3, 1, 0.9, 99), (3, 2, 0.9, 99)]
    log = spark.createDataFrame(rows, "conv_id long, t long, gate double, token long")
    words = spark.createDataFrame([(5, "five"), (2, "EOS"), (7, "seven")], "idx int, word string")
    got = {r.conv_id: (r.t, r.forced, r.token, r.answer) for r in scoring.answers(log, 0.5, 2, 9, words).collect()}
    assert got == {1: (2, False, 5, "five"), 2: (2, True, 2, ""), 3: (2, False, 99, "<UNK>")}


def test_control_values(spark):
    c = lambda t, cap, **how: tuple(spark.range(1).select(A.control(F.lit(t), F.lit(cap), **how).alias("c")).first().c)
    assert c(0, 4, least=2) == (0.25, 0.75, 0.0, 0.15) and c(1, 4, least=2, extra=4.0, budget=0.5) == (0.25, 0.75, 1.0, 0.5)
    assert c(6, 4) == (1.75, 0.0, 1.0, 0.15) and c(0, 0) == (1.0, 0.0, 1.0, 0.15)


def test_top_words_are_rendered_with_six_decimals(spark):
    d = spark.createDataFrame([([("w", 0.5), ("x y", 1 / 3)],), ([],)], "top array<struct<word:string,p:double>>")
    assert [r[0] for r in d.select(A.rendered_top(F.col("top"))).collect()] == ["w:0.500000 x y:0.333333", ""]


# ---- errors and options
def test_indexes_out_of_range_are_errors(spark):
    lengths = chunks.offsets(spark.createDataFrame([(0, 10), (1, 5)], "chunk_no bigint, n bigint"))
    found = lambda *i: chunks.locate(spark.createDataFrame([(x,) for x in i], "idx bigint"), lengths, strict=True).collect()
    assert {tuple(r) for r in found(0, 14)} == {(0, 0, 0), (14, 1, 4)}
    for i in (15, -1):
        with pytest.raises(Exception, match=f"no chunk has index {i}"):
            found(3, i)


def test_no_chunks_are_an_error_and_ten_comes_after_nine(spark, tmp_path):
    d = spark.range(30).select(F.lit("train").alias("split"), F.floor(F.col("id") / 2).alias("chunk_no"), (F.col("id") % 2).alias("pos"), "id")
    io.write_chunks(d, f"file://{tmp_path}/chunks")
    assert [r.id for r in io.read_chunks(spark, f"file://{tmp_path}/chunks").collect()] == list(range(30))
    d.where("false").write.parquet(f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="no chunks"):
        io.read_chunks(spark, f"file://{tmp_path}/none")


def test_chunks_followed_by_bytes(spark, tmp_path):
    d = spark.range(400).select((F.col("id") / 50).cast("long").alias("chunk_no"), "id")
    d.repartition(8, "chunk_no").write.parquet(f"file://{tmp_path}/chunks")
    seen = []

    def put(rows, batch):
        seen.append(rows.count())

    stream = live.follow_chunks(spark, f"file://{tmp_path}/chunks", d.schema, max_bytes="1")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 2 and sum(seen) == 400


def test_ascii_lines_do_not_travel(spark):
    lines = spark.createDataFrame([('["ab", "cd"]',), ('["ＡＢ", "cd"]',), ('[null, "cd"]',)], "value string")
    own = io.encoder(spark.createDataFrame([("ab", 4, 1), ("cd", 5, 1)], "word string, idx int, n bigint"))
    assert [r.steps[0].x_t for r in live.encoded_lines(lines, own).collect()] == [[4, 2], [4, 2], [2]]


def test_steps_are_encoded_once(spark):
    rows = spark.createDataFrame([("train", 1, p, x, t, g) for p, x, t, g in [(0, None, "a", 1.0), (1, "b", None, 1.0), (2, None, "c", 1.0), (3, "", "d", 1.0), (4, None, "e", 0.0)]], "split string, conv_id long, pos int, input_text string, target_text string, gate double")
    own = io.encoder(spark.createDataFrame([(w, k + 4, 1) for k, w in enumerate("abcde")], "word string, idx int, n bigint"))
    got = encode.step_format(rows, lambda c: own(T.tokens(c)))
    assert [(r.x_ref, r.x_t, r.target) for r in got.sort("step").collect()] == [([5, 2], [2], [4, 2]), ([5, 2], [5, 2], [2]), ([5, 2], [5, 2], [6, 2]), ([5, 2], [2], [7, 2]), ([5, 2], None, [])]


def test_a_segmenter_of_python_in_batch_and_live_jobs(spark, tmp_path):
    import json

    import pandas as pd
    from pyspark.sql.types import ArrayType, StringType

    lines = [["hello 12345 x1", "wörld ＡＢ http://u.v"], ["x", "", "hello you"]]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    words = spark.createDataFrame([(w, k + 4, 1) for k, w in enumerate(["hello", "<NUM>", "ab", "wö", "you"])], "word string, idx int, n bigint")
    cut = lambda t: [t[k : k + 2] if not t.isascii() else t for t in t.split() for k in (range(0, len(t), 2) if not t.isascii() else (0,))]

    @F.pandas_udf(ArrayType(StringType()))
    def own(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    live_rows = live.encoded_lines(spark.read.text(f"file://{tmp_path}/a.jsonl"), io.encoder(words), segment=live.segmenter(cut)).select(F.explode("steps").alias("s")).select("s.*").collect()
    turns = io.utterances(io.elements(io.read_lines(spark, f"file://{tmp_path}/a.jsonl"))).withColumn("toks", T.tokens(F.col("text"), tokenizer=own))
    batch = encode.steps(encode.token_ids(turns, words)).select("x_t", "target", "gate").collect()
    assert sorted(map(tuple, live_rows)) == sorted(map(tuple, batch)) and len(batch) == 3
    assert any(7 in r.target for r in batch)


def test_collate_with_a_function(spark):
    d = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "batch_no long, row long, name string")
    s = spark.createDataFrame([(0, 1, 0, [5]), (0, 0, 1, [6, 7]), (0, 0, 0, [8]), (1, 0, 0, [9])], "batch_no long, row long, step int, target array<int>")
    out = batches.collate_with(d, s, lambda b: b.assign(flat=[",".join(str(x) for t in b.target for x in t)] * len(b))[["batch_no", "name", "flat"]].drop_duplicates(), "batch_no long, name string, flat string")
    assert sorted(map(tuple, out.collect())) == [(0, "a", "8,6,7,5"), (0, "b", "8,6,7,5"), (1, "c", "9")]


def test_collation_shuffles_once(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 5)], "batch_no long, row long")
    s = spark.createDataFrame([(0, 0, 2, [5], [6, 7], 1.0), (0, 1, 0, None, [8], 1.0), (1, 0, 0, [9], None, 0.0), (0, 9, 7, [1], [1], 1.0)], "batch_no long, row long, step int, x_t array<int>, target array<int>, gate double")
    out = batches.collate(d, s)
    got = {(r.batch_no, r.step, r.row): (r.x_t, r.target, r.gate) for r in out.where("batch_no < 2 and step < 3").collect()}
    assert got == {(0, 0, 0): (None, [0], 0.0), (0, 0, 1): (None, [8], 1.0), (0, 1, 0): (None, None, 0.0), (0, 1, 1): (None, None, 0.0), (0, 2, 0): ([5], [6, 7], 1.0), (0, 2, 1): ([0], [0, 0], 0.0), (1, 0, 0): ([9], None, 0.0)}
    assert out.where("batch_no = 2").count() == 0 and plan_of(out).count("Exchange") == 1
