"""Literal inputs with results derived by hand."""

import math

import pytest
from pyspark.sql import functions as F

from dialoom.functions import arrays as A
from dialoom.functions import text as T
from dialoom.operators import batches, chunks, encode, quality, scoring, vocab
from dialoom.sources import io

WORDS = {"hello": 4, "world": 5, "how": 6, "are": 7, "you": 8, "i": 9, "am": 10, "fine": 11}
LINES = [
    '[{"text":"hello world"},{"text":"how are you"}]', '["hello","world"]', '["only one"]', "[]", '{"text":"a"}', "not json", '[{"text":"hello"},"world",5,null]', '[{"text":5},{"text":"hello"}]',
    '[{"input_text":null,"target_text":"hello","gate_signal":1}]', '[{"gate_signal":"abc"}]', '[{"foo":1},{"bar":2}]', "[null,null]", '["hello","world"] x', '[{"text":"hello","text":"world"},{"text":"you"}]',
    '[{"step":0,"input_text":"hello world","gate_signal":0},{"step":1,"input_text":null,"target_text":"how are you","gate_signal":1},{"step":2,"input_text":"","target_text":"i am fine","gate_signal":"1"},{"step":3,"target_text":"x","gate_signal":true}]',
]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w, i, 1) for w, i in WORDS.items()], "word string, idx int, n bigint")


@pytest.fixture(scope="module")
def parts(spark):
    lines = spark.createDataFrame([("train", 0, "f", n + 1, x) for n, x in enumerate(LINES)], "split string, split_ord int, file_name string, line_no bigint, value string")
    return io.elements(lines).cache()


def rows_of(df):
    return sorted((r.conv_id, r.step, r.x_ref, r.x_t, r.target, r.gate) for r in df.collect())


def test_formats_and_rejects(spark, words, parts):
    lines = spark.createDataFrame([("f", n + 1, x) for n, x in enumerate(LINES)], "file_name string, line_no bigint, value string")
    assert [r.line_no for r in io.rejects(lines).sort("line_no").collect()] == [5, 6, 13, 14]
    turns = io.utterances(parts).withColumn("toks", T.tokens(F.col("text")))
    got = rows_of(encode.steps(encode.token_ids(turns, words)))
    assert got == [
        (1, 0, [4, 5, 2], [4, 5, 2], [6, 7, 8, 2], 1.0), (2, 0, [4, 2], [4, 2], [5, 2], 1.0), (7, 0, [4, 2], [4, 2], [5, 2], 1.0), (7, 1, [4, 2], [5, 2], [3, 2], 1.0), (7, 2, [4, 2], [3, 2], [2], 1.0),
        (8, 0, [2], [2], [4, 2], 1.0), (11, 0, [2], [2], [2], 1.0), (12, 0, [2], [2], [2], 1.0),
    ]


def test_step_format(spark, words, parts):
    own = io.encoder(words)
    got = rows_of(encode.step_format(io.step_inputs(parts), lambda c: own(T.tokens(c))))
    assert got == [(9, 0, [2], [2], [4, 2], 1.0), (15, 0, [4, 5, 2], None, [], 0.0), (15, 1, [4, 5, 2], [4, 5, 2], [6, 7, 8, 2], 1.0), (15, 2, [4, 5, 2], [2], [9, 10, 11, 2], 1.0), (15, 3, [4, 5, 2], [2], [3, 2], 1.0)]


def test_text_cases(spark):
    cases = {
        "你好世界": ["你好世界"], "Hello World": ["hello", "world"], "你好，世界！": ["你好", "世界"], "今天天气很好123": ["今天天气很好", "123"], "": [], "   ": [], "Ｈｅｌｌｏ　１２３４５": ["hello", "<NUM>"],
        "see HTTPS://x.y/z?q=1 ok": ["see", "ok"], "mail a.b@c.com now": ["mail", "now"], "a😀b x→y": ["ab", "xy"], "café 1234 12345 abc123": ["caf", "1234", "<NUM>", "abc", "123"],
    }
    d = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", T.tokens(F.col("t")).alias("w"))
    assert {r.t: r.w for r in d.collect()} == cases | {None: []}


def test_vocabulary_orders_ties_by_first_appearance(spark):
    t = spark.createDataFrame([(0, 1, 0, ["b", "a", "a"]), (0, 2, 0, ["c", "b", "d"]), (1, 0, 0, ["d", "c", "e"])], "split_ord int, conv_id bigint, turn int, toks array<string>")
    counts = vocab.word_counts(t)
    v = vocab.vocabulary(counts, size=10, min_freq=2)
    assert [(r.word, r.idx, r.n) for r in v.sort("idx").collect()] == [("b", 4, 2), ("a", 5, 2), ("c", 6, 2), ("d", 7, 2)]
    assert vocab.totals(counts).first()[:] == (9, 5, 4, 4)
    assert [r.words for r in vocab.histogram(counts).sort("bucket").collect()] == [1, 4, 0, 0, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        vocab.vocabulary(counts, size=0)


def test_think_steps_and_compare(spark):
    s = spark.createDataFrame([("train", 1, 0, [4, 5, 2], [4, 5, 2], [6, 7, 8, 2], 1.0), ("train", 1, 1, [4, 5, 2], [6, 7, 8, 2], [3, 10, 11, 2], 1.0)], "split string, conv_id bigint, step int, x_ref array<int>, x_t array<int>, target array<int>, gate double")
    six = rows_of(encode.with_thinking(s, 2))
    assert [r[1] for r in six if r[5] == 1.0] == [2, 5] and all(r[3] is None and r[4] == [] for r in six if r[5] == 0.0) and len(six) == 6
    old = s.withColumn("target", F.transform("target", lambda x: F.when(x == 3, 9).otherwise(x)))
    assert [tuple(r) for r in quality.differences(s, old).collect()] == [(1, 1, "target")]


def test_decode(spark, words):
    rows = spark.createDataFrame([(1, [4, 5, 2, 0, 0]), (2, [99, 2])], "key int, ids array<int>")
    d = vocab.decode_table(words)
    assert {r.key: r.words for r in encode.decoded(rows, d).collect()} == {1: ["hello", "world", "EOS"], 2: ["<UNK:99>", "EOS"]}
    long = spark.createDataFrame([(3, [4, 5, 6])], "key int, ids array<int>")
    assert encode.decoded(long, d, max_len=2).first().words == ["hello", "world", "<...>"]


def test_collate_and_forced_rows(spark):
    d = spark.createDataFrame([(0, 0, [4, 5, 2]), (0, 1, [6, 2]), (1, 0, [6, 2])], "batch_no bigint, row bigint, x_ref array<int>")
    s = spark.createDataFrame(
        [(0, 0, 1, 0, [4, 5, 2], [4, 5, 2], [6, 7, 8, 2], 1.0), (0, 0, 1, 1, [4, 5, 2], [6, 7, 8, 2], [3, 10, 11, 2], 1.0), (0, 1, 2, 0, [6, 2], None, [], 0.0), (1, 0, 3, 0, [6, 2], None, [], 0.0)],
        "batch_no bigint, row bigint, conv_id bigint, step int, x_ref array<int>, x_t array<int>, target array<int>, gate double",
    )
    got = {(r.batch_no, r.step, r.row): (r.x_t, r.target, r.gate) for r in batches.collate(d, s).collect()}
    assert got == {(0, 0, 0): ([4, 5, 2], [6, 7, 8, 2], 1.0), (0, 0, 1): ([0, 0, 0], [0] * 4, 0.0), (0, 1, 0): ([6, 7, 8, 2], [3, 10, 11, 2], 1.0), (0, 1, 1): ([0] * 4, [0] * 4, 0.0), (1, 0, 0): (None, None, 0.0)}
    assert {(r.batch_no, r.row): r.x_ref for r in batches.collate_reference(d).collect()} == {(0, 0): [4, 5, 2], (0, 1): [6, 2, 0], (1, 0): [6, 2]}
    forced = [(r.context, r.j, r.prefix, r.gold) for r in batches.forced(s).where("conv_id = 1 and step = 0").sort("j").collect()]
    assert forced == [([4, 5, 2], 0, None, 6), ([4, 5, 2], 1, [6], 7), ([4, 5, 2], 2, [6, 7], 8), ([4, 5, 2], 3, [6, 7, 8], 2)]
    assert batches.forced(s).where("conv_id = 2").count() == 0
    assert {r.conv_id: r.final for r in batches.final_target(s, with_tokens=True).collect()}[1] == [3, 10, 11, 2]


def test_chunks(spark):
    lengths = spark.createDataFrame([(0, 10000), (1, 10000), (2, 5)], "chunk_no bigint, n bigint")
    found = chunks.locate(spark.createDataFrame([(10000,), (20004,), (20005,)], "idx bigint"), chunks.offsets(lengths))
    assert {r.idx: (r.chunk_no, r.local) for r in found.collect()} == {10000: (1, 0), 20004: (2, 4), 20005: (None, None)}
    numbers = spark.createDataFrame([(0,), (1,), (2,), (4,)], "chunk_no bigint")
    assert [r[0] for r in chunks.missing(numbers).collect()] == [3]
    mark = lambda ns, kind: spark.createDataFrame([(n, kind) for n in ns], "chunk_no bigint, kind string")
    both = lambda **how: {r.chunk_no: r.kind for r in chunks.reconcile(mark([0, 1, 2, 4], "c"), mark([2, 5], "p"), **how).collect()}
    assert both() == {0: "c", 1: "c", 2: "c", 4: "c", 5: "p"} and both(partial_wins=True)[2] == "p"
    names = spark.createDataFrame([("chunk_2.pt",), ("chunk_10.pt",), ("chunk_x.pt",)], "name string").select(quality.chunk_number(F.col("name")).alias("n"))
    assert [r.n for r in names.where("n is not null").sort("n").collect()] == [2, 10]


def test_ordinals_are_dense(spark):
    d = spark.range(1000).select((F.col("id") % 3).cast("int").alias("split_ord"), ((F.col("id") * 7919) % 100_003).alias("conv_id"))
    got = [(r.split_ord, r.conv_id, r.ordinal) for r in chunks.dense_ordinal(d, "split_ord", "conv_id", bucket=chunks.by_key(d, 64)).collect()]
    assert [x[2] for x in sorted(got)] == list(range(1000))
    sparse = spark.range(1000).select(F.lit(0).alias("split_ord"), (F.col("id") * 9_007_199_254_740).alias("conv_id"))
    bucket = chunks.by_key(sparse, 64)
    assert max(r["count"] for r in sparse.groupBy(*bucket).count().collect()) <= 80  # far ids don't make one bucket each, or one of all
    assert sparse.select(*bucket).distinct().count() <= 25


def test_places_have_no_caps(spark):
    """Words past position 2048 and turns past 1024 keep their order."""
    rows = [(0, 1, 0, ["a"]), (0, 1, 5000, ["z", *["a"] * 5000, "y", "x"]), (0, 1 << 50, 0, ["w"]), (0, 1, 5001, ["v", "w"]), (1, 0, 0, ["u"])]
    d = spark.createDataFrame(rows, "split_ord int, conv_id bigint, turn int, toks array<string>")
    assert [r.word for r in vocab.word_counts(d).sort("first_seen").collect()] == ["a", "z", "y", "x", "v", "w", "u"]
    s = spark.createDataFrame([(3, 2000, "b " * 3000 + "c d"), (3, 1999, "e"), (1 << 45, 0, "f")], "line bigint, turn int, text string")
    assert [r.word for r in vocab.incremental(s).sort("idx").collect()] == ["e", "b", "c", "d", "f"]


def test_tokenizer_hook(spark):
    d = spark.createDataFrame([("Hello, wörld 123456 中文x",), (None,)], "text string").select(T.tokens(F.col("text"), tokenizer=lambda c: F.split(c, " ")).alias("t"))
    assert [r.t for r in d.collect()] == [["wörld", "<NUM>", "中文x"], []]


def test_decisions_and_losses(spark):
    g = spark.createDataFrame([(1, t + 1, x) for t, x in enumerate([0.2, 0.7, 0.4, 0.9])], "conv_id bigint, t bigint, gate double")
    pick = lambda thr, least, most: tuple(scoring.speak_step(g, thr, least, most).first()[1:])
    assert pick(0.5, 1, 9) == (2, False) and pick(0.5, 3, 9) == (4, False) and pick(0.5, 3, 3) == (3, True) and pick(0.95, 1, 9) == (4, True)
    one = spark.range(1).select(*(A.temperature(F.lit(t)).alias(f"t{t}") for t in (0, 1, 40)), scoring.gate_bce(F.lit(0.0), F.lit(1.0)).alias("a"), scoring.gate_bce(F.lit(0.0), F.lit(0.0)).alias("b"), A.entropy(A.guarded_gate(F.lit(float("nan")))).alias("e"), A.guarded_gate(F.lit(float("inf"))).alias("i")).first()
    assert [round(x, 6) for x in one[:3]] == [1.5, 1.425, 0.2]
    assert math.isclose(one.a, 1.2 * math.log(2)) and math.isclose(one.b, math.log(2)) and math.isclose(one.e, math.log(2)) and math.isclose(one.i, 1 / (1 + math.exp(-10)))
    rows = spark.createDataFrame([(1, [2.0, 1.0, 0.5], 2), (2, [0.0, 3.0, 1.0], 0)], "key bigint, logits array<double>, label int")
    wide = {r.key: r.ce for r in scoring.token_ce_wide(rows).collect()}
    slim = {r.key: r.ce for r in rows.select("key", scoring.token_ce(F.col("logits"), F.col("label")).alias("ce")).collect()}
    assert math.isclose(wide[1], slim[1]) and wide[2] is None and slim[2] is None


def test_quality(spark):
    s = spark.createDataFrame([("t", 1, 0, [4], None, [5, 2], 1.0), ("t", 1, 1, [-1], [10], [2], 0.5)], "split string, conv_id bigint, step int, x_ref array<int>, x_t array<int>, target array<int>, gate double")
    assert tuple(quality.violations(s, 10).first()) == (2, 2, 1, 0)


def windows(df):
    """The columns that each window over rows is partitioned by."""
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+L?", "", w[1]) for w in re.finditer(r"windowspecdefinition\((.*?) ASC", plan)]


def test_no_window_over_a_whole_split(spark, sf_dir):
    from dialoom.operators import scoring
    from dialoom.plans import registry

    assert not any(w.startswith("split, conv_id") for w in windows(registry.QUERIES["p6_element_text"](spark, sf_dir)))
    assert not any(w.startswith("split, total_steps") for w in windows(registry.QUERIES["w9_best_so_far"](spark, sf_dir)))
    rows = [("a", 1, 5.0), ("a", 2, None), ("a", 3, 6.0), ("a", 9, 4.0), ("a", 10, 4.0), ("a", None, 9.0), (None, 3, 1.0), (None, 8, 0.5), ("b", 7, None), ("b", 8, 2.0)]
    got = scoring.best_so_far(spark.createDataFrame(rows, "split string, total_steps long, loss double"), "split", width=3).collect()
    want = {("a", None): (None, True), ("a", 1): (9.0, True), ("a", 2): (5.0, None), ("a", 3): (5.0, False), ("a", 9): (5.0, True), ("a", 10): (4.0, False), (None, 3): (None, True), (None, 8): (1.0, True), ("b", 7): (None, True), ("b", 8): (None, True)}
    assert {(r.split, r.total_steps): (r.best_before, r.new_best) for r in got} == want
