"""Registered queries: sources and sinks, cleaning, vocabulary, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions.arrays import rendered
from dialoom.operators import chunks, encode, quality, vocab
from dialoom.plans import base
from dialoom.plans.base import load, scratch, show, sql
from dialoom.plans.registry import query
from dialoom.sources import io

STEP_SQL = f"SELECT split, conv_id, CAST(step AS BIGINT) AS step, {show('x_ref')} AS x_ref, {show('x_t')} AS x_t, {show('target')} AS target, gate FROM "


def shown(steps: DataFrame) -> DataFrame:
    return steps.select("split", F.col("conv_id").cast("long"), F.col("step").cast("long"), rendered(F.col("x_ref")).alias("x_ref"), rendered(F.col("x_t")).alias("x_t"), rendered(F.col("target")).alias("target"), "gate")


def write_dialogues(spark: SparkSession, sf_dir: str, layout: str) -> dict[str, str]:
    """The conversations as JSONL in three split folders, one line a dialogue in order of its number."""
    t = base.turns(spark, sf_dir)
    if layout == "strings":
        item = F.col("text")
    elif layout == "utterance":
        item = F.struct("text")
    else:
        user = F.col("role") == "user"
        item = F.struct(F.col("turn").alias("step"), F.when(user, F.col("text")).alias("input_text"), F.when(~user, F.col("text")).alias("target_text"), F.when(user, 0).otherwise(1).alias("gate_signal"))
    lines = t.groupBy("split", "conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"])).alias("value"))
    path = scratch(spark, "jsonl")
    lines.repartitionByRange("split", "conv_id").sortWithinPartitions("split", "conv_id").select("split", "value").write.partitionBy("split").text(path)
    return {name: f"{path}/split={name}/*" for name, _ in io.SPLITS}


LINES = ("lines", "SELECT *, dense_rank() OVER (PARTITION BY split ORDER BY conv_id) - 1 AS line FROM turns")


@query(sql("turns", "SELECT split, CAST(line AS BIGINT) AS line_no, CAST(turn AS BIGINT) AS turn, text FROM lines", LINES))
def s1_read_jsonl(spark, sf_dir):
    parts = io.elements(io.read_splits(spark, write_dialogues(spark, sf_dir, "utterance")))
    return parts.select("split", F.col("conv_id").alias("line_no"), F.col("pos").cast("long").alias("turn"), "text")


@query(sql("turns", "SELECT split, split_ord::BIGINT AS split_ord, count(DISTINCT conv_id) AS dialogues FROM turns WHERE split <> 'valid' GROUP BY 1, 2"))
def s2_splits_missing_one(spark, sf_dir):
    paths = write_dialogues(spark, sf_dir, "strings")
    paths["valid"] = paths["valid"].replace("split=valid", "split=absent")
    return io.read_splits(spark, paths).groupBy("split", F.col("split_ord").cast("long").alias("split_ord")).agg(F.count("*").alias("dialogues"))


@query(sql("turns", "SELECT split, CAST(count(*) AS BIGINT) AS rejected FROM (SELECT DISTINCT split, conv_id FROM turns WHERE conv_id % 7 = 0) GROUP BY split"))
def p1_rejected_lines(spark, sf_dir):
    """Every seventh dialogue gets text after its list, which makes its line malformed."""
    t = base.turns(spark, sf_dir).groupBy("split", "conv_id").agg(F.to_json(F.collect_list("text")).alias("v"))
    lines = t.select("split", F.lit("f").alias("file_name"), F.col("conv_id").alias("line_no"), F.when(F.col("conv_id") % 7 == 0, F.concat("v", F.lit(" x"))).otherwise(F.col("v")).alias("value"))
    bad = io.rejects(lines.withColumn("file_name", F.col("split")))
    return bad.groupBy(F.col("file_name").alias("split")).agg(F.count("*").alias("rejected"))


@query(sql("turns", "SELECT split, CAST(count(*) AS BIGINT) AS kept FROM (SELECT DISTINCT split, conv_id FROM turns WHERE conv_id % 3 = 0) GROUP BY split"))
def p2_lists_only(spark, sf_dir):
    """Two of three dialogues become an object or an empty list; only lists with elements stay."""
    t = base.turns(spark, sf_dir).groupBy("split", "split_ord", "conv_id").agg(F.collect_list("text").alias("l"))
    value = F.when(F.col("conv_id") % 3 == 0, F.to_json("l")).when(F.col("conv_id") % 3 == 1, F.to_json(F.struct("l"))).otherwise("[]")
    parts = io.elements(t.select("split", "split_ord", F.col("conv_id").alias("line_no"), value.alias("value")))
    return parts.groupBy("split").agg(F.count_distinct("conv_id").alias("kept"))


@query(sql("turns", "SELECT CASE conv_id % 3 WHEN 0 THEN 'strings' WHEN 1 THEN 'utterance' ELSE 'step' END AS format, CAST(count(DISTINCT conv_id) AS BIGINT) AS dialogues FROM turns GROUP BY 1"))
def p3_format_sniffing(spark, sf_dir):
    t = base.turns(spark, sf_dir).groupBy("split", "split_ord", "conv_id").agg(F.collect_list("text").alias("l"))
    other = lambda name: F.to_json(F.transform("l", lambda x: F.struct(x.alias(name))))
    value = F.when(F.col("conv_id") % 3 == 0, F.to_json("l")).when(F.col("conv_id") % 3 == 1, other("text")).otherwise(other("target_text"))
    parts = io.elements(t.select("split", "split_ord", F.col("conv_id").alias("line_no"), value.alias("value")))
    return parts.groupBy("format").agg(F.count_distinct("conv_id").alias("dialogues"))


@query(sql("turns", "SELECT split, conv_id, turn, text FROM turns QUALIFY count(*) OVER (PARTITION BY split, conv_id) BETWEEN 3 AND 6"))
def p4_dialogue_length(spark, sf_dir):
    return encode.long_enough(base.turns(spark, sf_dir), 3, 6).select("split", "conv_id", F.col("turn").cast("long"), "text")


STEP_INPUT = ("si", "SELECT split, split_ord, conv_id, line, turn AS pos, CASE WHEN role = 'user' THEN text END AS input_text, CASE WHEN role <> 'user' THEN text END AS target_text, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS gate FROM lines")


@query(sql("turns", "SELECT split, CAST(line AS BIGINT) AS conv_id, CAST(pos AS BIGINT) AS turn, CASE WHEN input_text <> '' THEN 1 ELSE 2 END AS field, coalesce(input_text, target_text) AS text FROM si WHERE coalesce(input_text, target_text) <> ''", LINES, STEP_INPUT))
def p5_counted_texts(spark, sf_dir):
    parts = io.elements(io.read_splits(spark, write_dialogues(spark, sf_dir, "step")))
    return io.counted_texts(parts).join(spark.createDataFrame([(n, k) for n, k in io.SPLITS], "split string, split_ord int"), "split_ord").select("split", "conv_id", F.col("turn").cast("long"), F.col("field").cast("int"), "text")


@query(sql("turns", "SELECT split, CAST(line AS BIGINT) AS line_no, CAST(turn AS BIGINT) AS turn, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS text FROM lines", LINES))
def p6_element_text(spark, sf_dir):
    """Objects with text in mixed lists, and nulls, which count as ''."""
    t = base.turns(spark, sf_dir)
    item = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("text"))).otherwise("null")
    d = t.groupBy("split", "split_ord", "conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), ","), F.lit("]")).alias("value"))
    d = chunks.dense_ordinal(d, "split_ord", "conv_id", bucket=chunks.by_key(t))
    starts = d.groupBy("split_ord").agg(F.min("ordinal").alias("start"))
    parts = io.elements(d.join(starts, "split_ord").select("split", "split_ord", (F.col("ordinal") - F.col("start")).alias("line_no"), "value"))
    return io.utterances(parts, 1).select("split", F.col("conv_id").alias("line_no"), F.col("turn").cast("long"), "text")


@query(sql("turns", "SELECT split, CAST(count(*) AS BIGINT) AS kept FROM (SELECT split, conv_id FROM turns GROUP BY 1, 2 HAVING conv_id % 5 <> 0 AND count(*) >= 2) GROUP BY split"))
def p7_without_steps(spark, sf_dir):
    """Dialogues that give steps: every fifth has a gate that is no number, which drops it whole."""
    t = base.turns(spark, sf_dir)
    gate = F.when(F.col("conv_id") % 5 == 0, "abc").otherwise("1")
    d = t.groupBy("split", "split_ord", "conv_id").agg(F.to_json(F.collect_list(F.struct(F.col("text").alias("target_text"), gate.alias("gate_signal")))).alias("value"))
    rows = io.step_inputs(io.elements(d.withColumnRenamed("conv_id", "line_no")))
    return rows.groupBy("split").agg(F.count_distinct("conv_id").alias("kept"))


@query(sql("cnt", "SELECT word, CAST(n AS BIGINT) AS n FROM cnt WHERE n >= 5"))
def p8_min_frequency(spark, sf_dir):
    return base.counts(spark, sf_dir).where("n >= 5").select("word", "n")


@query(sql("turns", r"SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^\p{L}+$') OR regexp_matches(w, '^\p{Nd}+$')), ' ') AS kept FROM turns"))
def p9_token_kinds(spark, sf_dir):
    return base.turns(spark, sf_dir).select("conv_id", F.col("turn").cast("long"), F.array_join(T.kept_kinds(F.split("text", " ")), " ").alias("kept"))


@query(sql("turns", "SELECT conv_id, turn, text FROM turns WHERE split = 'valid'"))
def p10_split_selection(spark, sf_dir):
    return base.turns(spark, sf_dir).where("split = 'valid'").select("conv_id", F.col("turn").cast("long"), "text")


@query("SELECT doc_id, array_to_string(" + base.tokens_sql("text") + ", ' ') AS toks FROM documents")
def f1_f7_document_tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("toks"))


@query(r"SELECT page_id, regexp_replace('see ' || url || ' now', '(?i)https?://\S+|www\.\S+', ' ', 'g') AS text FROM pages")
def f2_urls(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.drop_urls(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("text"))


@query(r"SELECT doc_id, CAST(length(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', ' ', 'g')) AS BIGINT) AS n, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', ' ', 'g')) AS digest FROM documents")
def f3_emails(spark, sf_dir):
    kept = T.drop_emails(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(kept).cast("long").alias("n"), F.md5(kept.cast("binary")).alias("digest"))


@query(r"SELECT doc_id, CAST(length(regexp_replace(text || ' →☀✂ x', '[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{2190}-\x{2BFF}]', '', 'g')) AS BIGINT) AS n, md5(regexp_replace(text || ' →☀✂ x', '[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{2190}-\x{2BFF}]', '', 'g')) AS digest FROM documents")
def f4_symbols(spark, sf_dir):
    kept = T.drop_symbols(F.concat("text", F.lit(" →☀✂ x")))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(kept).cast("long").alias("n"), F.md5(kept.cast("binary")).alias("digest"))


@query(sql("cnt", "SELECT word, CAST(n AS BIGINT) AS n FROM cnt"))
def a1_word_frequency(spark, sf_dir):
    return base.counts(spark, sf_dir).select("word", "n")


@query(sql("cnt", "SELECT CAST(sum(n) AS BIGINT) AS total_tokens, count(*) AS distinct_words, count(*) FILTER (n >= 2) AS kept_words, least(count(*) FILTER (n >= 2), 30000) AS selected_words FROM cnt"))
def a2_totals(spark, sf_dir):
    return vocab.totals(base.counts(spark, sf_dir))


@query(sql("words", "SELECT split, true AS close, count(*) AS tokens FROM words JOIN (SELECT DISTINCT split, split_ord FROM turns) USING (split_ord) GROUP BY split"))
def a2_approximate_words(spark, sf_dir):
    """Distinct words of each split from sketches by fifty dialogues, stored in two runs, against the exact numbers: at
    most two in a hundred apart."""
    path, toks = scratch(spark, "sketches"), base.stored(base.tokenised(spark, sf_dir).withColumn("part", F.floor(F.col("conv_id") / 50)), "tokens")
    for run in (0, 1):
        vocab.sketches(toks.where(F.col("part") % 2 == run), "split", "part").write.mode("append").parquet(path)
    about = vocab.distinct_words(spark.read.schema("split string, part long, sketch binary, tokens long").parquet(path), "split")
    exact = toks.select("split", F.explode("toks").alias("word")).groupBy("split").agg(F.count_distinct("word").alias("n"))
    return about.join(exact, "split").select("split", (F.abs(F.col("distinct_words") - F.col("n")) <= 0.02 * F.col("n")).alias("close"), "tokens")


@query(sql("cnt", "SELECT CAST(b.bucket AS BIGINT) AS bucket, count(word) AS words FROM range(8) AS b(bucket) LEFT JOIN (SELECT word, CASE WHEN n <= 1 THEN 0 WHEN n <= 5 THEN 1 WHEN n <= 10 THEN 2 WHEN n <= 50 THEN 3 WHEN n <= 100 THEN 4 WHEN n <= 500 THEN 5 WHEN n <= 1000 THEN 6 ELSE 7 END AS bucket FROM cnt) c USING (bucket) GROUP BY 1"))
def a3_histogram(spark, sf_dir):
    return vocab.histogram(base.counts(spark, sf_dir))


INCREMENTAL = ("inc", "SELECT word, count(*) AS n, row_number() OVER (ORDER BY min(seen)) + 3 AS idx FROM (SELECT word, row_number() OVER (ORDER BY conv_id, turn, pos) AS seen FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations)) GROUP BY word")


def _incremental(spark, sf_dir):
    return vocab.incremental(load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("line"), "turn", "text"))


@query(sql("", "SELECT word, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n FROM inc", INCREMENTAL))
def a4_incremental_vocabulary(spark, sf_dir):
    return _incremental(spark, sf_dir).select("word", F.col("idx").cast("long"), "n")


@query(sql("", "SELECT word, CAST(row_number() OVER (ORDER BY idx) + 3 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS n FROM inc WHERE n >= 3", INCREMENTAL))
def a5_trimmed_vocabulary(spark, sf_dir):
    return vocab.trimmed(_incremental(spark, sf_dir), 3).select("word", F.col("idx").cast("long"), "n")


@query(sql("", "SELECT word, CAST(row_number() OVER (ORDER BY idx) + 3 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS n, true AS trimmed FROM inc WHERE n >= 3", INCREMENTAL))
def a5_trimmed_twice(spark, sf_dir):
    """The second trim, of counts that are all 1 by then, leaves the vocabulary as it is."""
    once = vocab.trimmed(_incremental(spark, sf_dir), 3)
    return vocab.trimmed(once, 3).select("word", F.col("idx").cast("long"), "n", "trimmed")


@query(sql("", "SELECT count(*) FILTER (n >= 3) AS kept, count(*) AS words, round(count(*) FILTER (n >= 3) / greatest(count(*), 1), 6) AS ratio FROM inc", INCREMENTAL))
def a5_trim_ratio(spark, sf_dir):
    return vocab.trim_ratio(_incremental(spark, sf_dir), 3)


@query(sql("vocab", "SELECT word, idx, CAST(n AS BIGINT) AS n FROM vocab"))
def w6_vocabulary_ids(spark, sf_dir):
    return base.vocabulary(spark, sf_dir).select("word", F.col("idx").cast("long"), "n")


FAR = ("far", "SELECT word, count(*) AS n, min(seen) AS first_seen FROM (SELECT word, row_number() OVER (ORDER BY split_ord, far, turn, pos) AS seen FROM (SELECT *, CAST(conv_id % 8 - 4 AS BIGINT) * 2305843009213693952 + conv_id AS far FROM words)) GROUP BY word")


@query(sql("words", "SELECT word, CAST(row_number() OVER (ORDER BY n DESC, first_seen) + 3 AS BIGINT) AS idx, CAST(n AS BIGINT) AS n FROM far WHERE n >= 2", FAR))
def w6_ids_of_64_bits(spark, sf_dir):
    """Dialogue ids from -2^63 on, far apart as hashes are."""
    far = (F.col("conv_id") % 8 - 4) * F.lit(1 << 61) + F.col("conv_id")
    return vocab.vocabulary(vocab.word_counts(base.tokenised(spark, sf_dir).withColumn("conv_id", far)), size=1 << 30).select("word", F.col("idx").cast("long"), "n")


@query(sql("cnt", "SELECT word, CAST(n AS BIGINT) AS n FROM cnt ORDER BY n DESC, first_seen LIMIT 100"))
def t1_top_words(spark, sf_dir):
    return vocab.top_words(base.counts(spark, sf_dir), 100)


@query(sql("cnt", "SELECT word, CAST(n AS BIGINT) AS n FROM cnt ORDER BY n DESC, first_seen LIMIT 10"))
def t2_top_ten(spark, sf_dir):
    return vocab.top_words(base.counts(spark, sf_dir), 10)


@query(sql("vocab", "SELECT word, idx FROM vocab"))
def s6_s7_vocabulary_file(spark, sf_dir):
    path = scratch(spark, "vocab")
    io.write_vocabulary(base.vocabulary(spark, sf_dir), path)
    return io.read_vocabulary(spark, path).select("word", F.col("idx").cast("long"))


@query(sql("cnt", "SELECT count(*) FILTER (n >= 2) AS vocab_size, CAST(sum(n) AS BIGINT) AS total_words_processed, count(*) AS unique_words_found, 2::INTEGER AS min_frequency, (SELECT string_agg(word || ':' || n, ' ' ORDER BY n DESC, first_seen) FROM (SELECT * FROM cnt ORDER BY n DESC, first_seen LIMIT 10)) AS top FROM cnt"))
def s6_statistics_file(spark, sf_dir):
    """The statistics document, written and read back."""
    path = scratch(spark, "statistics")
    io.write_statistics(base.stored(base.counts(spark, sf_dir), "counts"), path)
    doc = spark.read.schema("vocab_size long, total_words_processed long, unique_words_found long, min_frequency int, top_10_words array<struct<word:string,n:long>>").json(path)
    return doc.select("vocab_size", "total_words_processed", "unique_words_found", "min_frequency", F.array_join(F.transform("top_10_words", lambda x: F.concat(x["word"], F.lit(":"), x["n"].cast("string"))), " ").alias("top"))


@query(sql("vocab", "SELECT idx, word FROM vocab UNION ALL SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'PAD'), (1, 'SOS'), (2, 'EOS'), (3, 'UNK'))"))
def s7_index_file(spark, sf_dir):
    path = scratch(spark, "vocab")
    io.write_vocabulary(base.vocabulary(spark, sf_dir), path)
    return io.read_index(spark, path).select(F.col("idx").cast("long"), "word")


@query(sql("ids", f"SELECT split, conv_id, turn, {show('ids')} AS ids FROM ids"))
def j1_token_lookup(spark, sf_dir):
    return base.ids(spark, sf_dir).select("split", "conv_id", F.col("turn").cast("long"), rendered(F.col("ids")).alias("ids"))


@query(sql("ids", f"SELECT split, conv_id, turn, {show('ids')} AS ids FROM ids"))
def j1_token_lookup_dictionary(spark, sf_dir):
    """The same by the Arrow dictionary helper: no shuffle of tokens."""
    own = io.encoder(base.stored(base.vocabulary(spark, sf_dir), "vocabulary"))
    return base.tokenised(spark, sf_dir).select("split", "conv_id", F.col("turn").cast("long"), rendered(own(F.col("toks"))).alias("ids"))


@query(sql("ids", f"SELECT split, conv_id, turn, {show('ids')} AS ids FROM ids"))
def j1_token_lookup_by_file(spark, sf_dir):
    """The same with a dictionary for each file of stored tokens, as vocabularies go that are too large to broadcast. The
    number of files grows with the input: four, or one for each partition that is read."""
    files = max(4, base.turns(spark, sf_dir).rdd.getNumPartitions())
    toks = base.stored(base.tokenised(spark, sf_dir).repartition(files, "conv_id"), "tokens")
    ids = encode.token_ids(toks, base.vocabulary(spark, sf_dir), store=scratch(spark, "dictionaries"), most=1)
    return ids.select("split", "conv_id", F.col("turn").cast("long"), rendered(F.col("ids")).alias("ids"))


@query(sql("ids", "SELECT conv_id, turn, CASE WHEN len(toks) + 1 > 8 THEN array_to_string(list_append(list_transform(ids[1:8], lambda i: CASE WHEN i = 3 THEN 'UNK' ELSE m[i] END), '<...>'), ' ') ELSE array_to_string(list_transform(ids, lambda i: CASE i WHEN 3 THEN 'UNK' WHEN 2 THEN 'EOS' ELSE m[i] END), ' ') END AS words FROM ids JOIN tok USING (conv_id, turn), (SELECT map(list(idx), list(word)) AS m FROM vocab)"))
def j2_decode(spark, sf_dir):
    v = base.stored(base.vocabulary(spark, sf_dir), "vocabulary")
    d = vocab.decode_table(v)
    rows = encode.token_ids(base.tokenised(spark, sf_dir), v, bounded=True).select(F.struct("conv_id", "turn").alias("key"), "ids")
    return encode.decoded(rows, d, max_len=8).select("key.conv_id", F.col("key.turn").cast("long").alias("turn"), F.array_join("words", " ").alias("words"))


@query(sql("steps", STEP_SQL + "steps"))
def x1_w1_w2_steps(spark, sf_dir):
    return shown(base.steps(spark, sf_dir))


@query(sql("steps", "SELECT split, conv_id, CAST(step * 3 + k AS BIGINT) AS step, array_to_string(x_ref, ' ') AS x_ref, CASE WHEN k = 2 THEN array_to_string(x_t, ' ') END AS x_t, CASE WHEN k = 2 THEN array_to_string(target, ' ') ELSE '' END AS target, CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS gate FROM steps, range(3) AS r(k)"))
def x3_think_steps(spark, sf_dir):
    return shown(encode.with_thinking(base.steps(spark, sf_dir), 2))


CARRY = ("carry", "SELECT *, last_value(CASE WHEN input_text IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos) AS at, first_value(CASE WHEN input_text <> '' THEN pos END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r FROM si")


@query(sql("ids", f"SELECT c.split, CAST(line AS BIGINT) AS conv_id, CAST(pos AS BIGINT) AS step, coalesce({show('ref.ids')}, '2') AS x_ref, CASE WHEN gate = 1 THEN coalesce({show('inp.ids')}, '2') END AS x_t, CASE WHEN gate = 1 THEN {show('own.ids')} ELSE '' END AS target, gate::DOUBLE AS gate FROM carry c LEFT JOIN ids own ON own.conv_id = c.conv_id AND own.turn = c.pos LEFT JOIN ids inp ON inp.conv_id = c.conv_id AND inp.turn = c.at LEFT JOIN ids ref ON ref.conv_id = c.conv_id AND ref.turn = c.r", LINES, STEP_INPUT, CARRY))
def x2_w3_w4_step_format(spark, sf_dir):
    """Step records written as JSONL, read, sniffed, carried forward and encoded."""
    own = io.encoder(base.vocabulary(spark, sf_dir))  # read once
    parts = io.elements(io.read_splits(spark, write_dialogues(spark, sf_dir, "step")))
    return shown(encode.step_format(io.step_inputs(parts), lambda c: own(T.tokens(c))))


@query("SELECT conv_id, turn::BIGINT AS turn, array_to_string(" + base.numbers_sql("list_filter(string_split(" + base.clean_sql("text") + r", ' '), lambda w: regexp_matches(w, '[\x{4e00}-\x{9fff}]') OR regexp_matches(w, '^\p{L}+$') OR regexp_matches(w, '^\p{Nd}+$'))") + ", ' ') AS toks FROM conversations")
def utok_tokenizer_hook(spark, sf_dir):
    """Another tokenizer in place of the patterns: words cut at blanks, of which the kinds that count stay."""
    rows = base.tokenised(spark, sf_dir, tokenizer=lambda c: F.split(c, " "))
    return rows.select("conv_id", F.col("turn").cast("long"), F.array_join("toks", " ").alias("toks"))


BAD = ("bad", "SELECT split, CASE WHEN conv_id % 4 = 0 AND step = 1 THEN NULL ELSE x_ref END AS x_ref, x_t, CASE WHEN conv_id % 6 = 0 THEN NULL WHEN conv_id % 3 = 0 AND step % 2 = 0 THEN list_append(list_append(target, -1), 99999) ELSE target END AS target, CASE WHEN conv_id % 5 = 0 THEN 0.5 WHEN conv_id % 5 = 1 THEN 0.0 ELSE gate END AS gate FROM steps")
WRONG = "len(list_filter({0}, lambda x: x < 0 OR x >= 30004))"


def _damaged(spark, sf_dir):
    """Steps with faults that the checks have to find."""
    c, step, t = F.col("conv_id"), F.col("step"), F.col("target")
    target = F.when(c % 6 == 0, None).when((c % 3 == 0) & (step % 2 == 0), F.array_append(F.array_append(t, F.lit(-1)), F.lit(99999))).otherwise(t)
    gate = F.when(c % 5 == 0, 0.5).when(c % 5 == 1, 0.0).otherwise(F.col("gate"))
    return base.steps(spark, sf_dir).withColumns({"x_ref": F.when(~((c % 4 == 0) & (step == 1)), F.col("x_ref")), "target": target, "gate": gate})


@query(sql("steps", f"SELECT count(*) AS steps, CAST(sum(coalesce({WRONG.format('x_ref')}, 0) + coalesce({WRONG.format('x_t')}, 0) + coalesce({WRONG.format('target')}, 0)) AS BIGINT) AS bad_ids, count(*) FILTER (gate NOT IN (0, 1)) AS bad_gates, count(*) FILTER (len(target) > 0 AND target[-1] <> 2) AS bad_ends FROM bad", BAD))
def p14_violations(spark, sf_dir):
    return quality.violations(_damaged(spark, sf_dir), 30_004).select(*(F.col(c).cast("long") for c in ("steps", "bad_ids", "bad_gates", "bad_ends")))


@query(sql("steps", "SELECT split, count(*) AS n, count(*) FILTER (x_ref IS NULL OR len(x_ref) < 1) AS no_reference, count(*) FILTER (target IS NULL) AS no_target, count(*) FILTER (gate = 0 AND x_t IS NOT NULL) AS odd_think FROM bad GROUP BY split", BAD))
def p15_structure(spark, sf_dir):
    return quality.structure(_damaged(spark, sf_dir))
