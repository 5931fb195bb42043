"""Registered queries: chunks, merges, reconciliations, quality, batches, samples, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import arrays as A
from dialoom.functions.arrays import rendered
from dialoom.operators import batches, chunks, encode, quality, vocab
from dialoom.plans import base
from dialoom.plans.base import load, scratch, sql
from dialoom.plans.registry import query
from dialoom.sources import io, merge
from dialoom.sources.shared import remove
from dialoom.streaming import live

SIZE, BATCH = 10, 8

CHUNKED = ("chunked", f"SELECT *, n // {SIZE} AS chunk_no, n % {SIZE} AS pos FROM (SELECT *, row_number() OVER (ORDER BY split_ord, conv_id) - 1 AS n FROM (SELECT split, split_ord, conv_id, count(*) AS turns FROM turns GROUP BY 1, 2, 3))")
BATCHED = ("dlg", f"SELECT conv_id, x_ref, n // {BATCH} AS batch_no, n % {BATCH} AS row FROM (SELECT conv_id, x_ref, row_number() OVER (ORDER BY split_ord, conv_id) - 1 AS n FROM steps WHERE step = 0)")


def chunk_rows(spark, sf_dir) -> DataFrame:
    """Dialogues (split, conv_id, turns) in chunks of ten."""
    d = base.turns(spark, sf_dir).groupBy("split", "split_ord", "conv_id").agg(F.count("*").alias("turns"))
    return chunks.chunked(d, "split_ord", "conv_id", bucket=chunks.by_key(base.turns(spark, sf_dir)), size=SIZE)


def batched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(dialogues, steps) dealt to batches of eight."""
    s = base.stored(base.steps(spark, sf_dir), "steps").withColumn("split_ord", F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2))
    d = s.where("step = 0").select("split_ord", "conv_id", "x_ref")
    d = chunks.dense_ordinal(d, "split_ord", "conv_id", bucket=chunks.by_key(base.turns(spark, sf_dir))).select("conv_id", "x_ref", F.floor(F.col("ordinal") / BATCH).alias("batch_no"), (F.col("ordinal") % BATCH).alias("row"))
    return d, s.join(d.select("conv_id", "batch_no", "row"), "conv_id")


@query(sql("turns", "SELECT split, conv_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(pos AS BIGINT) AS pos FROM chunked", CHUNKED))
def w8_chunk_numbers(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("split", "conv_id", "chunk_no", "pos")


@query(sql("turns", "SELECT split, conv_id, turns, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(pos AS BIGINT) AS pos FROM chunked", CHUNKED))
def s3_s4_chunk_files(spark, sf_dir):
    path = scratch(spark, "chunks")
    io.write_chunks(chunk_rows(spark, sf_dir), path)
    return io.read_chunks(spark, path).select("split", "conv_id", "turns", F.col("chunk_no").cast("long"), "pos")


@query(sql("turns", "SELECT split, conv_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(pos AS BIGINT) AS pos FROM chunked WHERE chunk_no >= 2", CHUNKED))
def s5_u2_merged_store(spark, sf_dir):
    """Chunks from number 2 on, merged into one data set per split and read back."""
    path = scratch(spark, "merged")
    rows = chunk_rows(spark, sf_dir).where("chunk_no >= 2")
    io.write_merged(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select("split", "conv_id", "chunk_no", "pos")


@query(sql("turns", "SELECT split, conv_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(pos AS BIGINT) AS pos FROM chunked WHERE chunk_no >= 1", CHUNKED))
def u2_merge_skips_damaged(spark, sf_dir):
    """Two chunk folders and a damaged file merged in one scan that leaves the damaged one out."""
    path, rows = scratch(spark, "merge"), chunk_rows(spark, sf_dir).select("split", "conv_id", "chunk_no", "pos")
    rows.where("chunk_no % 2 = 0").write.parquet(f"{path}/even")
    rows.where("chunk_no % 2 = 1").write.parquet(f"{path}/odd")
    rows.select(F.concat(F.lit("no parquet "), F.col("conv_id").cast("string")).alias("value")).write.text(f"{path}/damaged")
    return chunks.merge_files(spark, [f"{path}/even", f"{path}/odd", f"{path}/damaged/*.txt"], start_chunk=1, on_corrupt="skip", schema=rows.schema)


STORED = "conv_id bigint, pos bigint"


def _some_damaged(spark, sf_dir) -> str:
    """A folder of chunk files, of which every fifth chunk from the third on is text under a chunk's name, and the last
    comes a second time under another number without the place of its rows."""
    path, rows = scratch(spark, "chunks"), base.stored(chunk_rows(spark, sf_dir).select("chunk_no", "conv_id", "pos"), "chunks")
    broken = F.col("chunk_no") % 5 == 2
    rows.where(~broken).repartition("chunk_no").write.partitionBy("chunk_no").parquet(path)
    rows.where(broken & (F.col("pos") == 0)).select("chunk_no", F.lit("no parquet").alias("value")).repartition("chunk_no").write.mode("append").partitionBy("chunk_no").text(path)
    late = F.max("chunk_no").over(Window.partitionBy())  # one number
    last = rows.groupBy("chunk_no").agg(F.max("conv_id").alias("conv_id")).withColumn("last", late).where("chunk_no = last")
    last.select((F.col("chunk_no") + 1000).alias("chunk_no"), "conv_id").coalesce(1).write.mode("append").partitionBy("chunk_no").parquet(path)
    return path


@query(sql("turns", "SELECT chunk_no, chunk_no % 5 <> 2 AS merged, CASE WHEN chunk_no % 5 <> 2 THEN n END AS rows FROM (SELECT CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n FROM chunked GROUP BY 1) UNION ALL SELECT CAST(max(chunk_no) + 1000 AS BIGINT), false, NULL FROM chunked", CHUNKED))
def u2_damaged_files(spark, sf_dir):
    """What the manifest of a merge says that left damaged chunks out."""
    source, target = _some_damaged(spark, sf_dir), scratch(spark, "merged")
    merge.merge(spark, source, target, STORED, on_corrupt="skip", commit=4)
    return merge.manifest(spark, target).select("chunk_no", F.col("error").isNull().alias("merged"), "rows")


@query(sql("turns", "SELECT CAST(chunk_no AS BIGINT) AS chunk_no, conv_id, CAST(pos AS BIGINT) AS pos FROM chunked WHERE chunk_no % 5 <> 2", CHUNKED))
def u2_merge_goes_on(spark, sf_dir):
    """A merge that stopped after its first run, and was started again; a half-written run lies where the second goes."""
    source, target = _some_damaged(spark, sf_dir), scratch(spark, "merged")
    merge.merge(spark, source, target, STORED, on_corrupt="skip", commit=3, most_runs=1)
    merge.read_merged(spark, target, STORED).write.parquet(f"{target}/data/commit=1")
    merge.merge(spark, source, target, STORED, on_corrupt="skip", commit=3)
    return merge.read_merged(spark, target, STORED).select("chunk_no", "conv_id", "pos")


@query(sql("turns", "SELECT split, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n FROM chunked GROUP BY ROLLUP (split, chunk_no)", CHUNKED))
def a6_dialogues_per_chunk(spark, sf_dir):
    return chunks.sizes(chunk_rows(spark, sf_dir))


OFFSETS = ("off", "SELECT chunk_no, CAST(sum(n) OVER (ORDER BY chunk_no) - n AS BIGINT) AS lo, CAST(sum(n) OVER (ORDER BY chunk_no) AS BIGINT) AS hi FROM (SELECT chunk_no, sum(turns) AS n FROM chunked GROUP BY 1)")


def _offsets(spark, sf_dir):
    return chunks.offsets(chunk_rows(spark, sf_dir).groupBy("chunk_no").agg(F.sum("turns").alias("n")))


@query(sql("turns", "SELECT CAST(chunk_no AS BIGINT) AS chunk_no, lo, hi FROM off", CHUNKED, OFFSETS))
def w7_chunk_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir)


@query(sql("turns", "SELECT CAST(i.idx AS BIGINT) AS idx, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(i.idx - lo AS BIGINT) AS local FROM (SELECT event_id * 3 AS idx FROM events) i LEFT JOIN off ON i.idx >= lo AND i.idx < hi", CHUNKED, OFFSETS))
def j5_range_join(spark, sf_dir):
    """Indexes (three times each event's number) to chunk and place; those past the end find none."""
    return chunks.locate(load(spark, sf_dir, "events").select((F.col("event_id") * 3).cast("long").alias("idx")), _offsets(spark, sf_dir))


def _partials(rows):
    """Partial rows of every third chunk, told apart by a mark."""
    mark = lambda df, x: df.withColumn("kind", F.lit(x))
    return mark(rows.where("chunk_no % 2 = 0"), "chunk"), mark(rows.where("chunk_no % 3 = 0"), "partial")


@query(sql("turns", "SELECT conv_id, CAST(chunk_no AS BIGINT) AS chunk_no, CASE WHEN chunk_no % 2 = 0 THEN 'chunk' ELSE 'partial' END AS kind FROM chunked WHERE chunk_no % 2 = 0 OR chunk_no % 3 = 0", CHUNKED))
def j3_chunk_wins(spark, sf_dir):
    return chunks.reconcile(*_partials(chunk_rows(spark, sf_dir))).select("conv_id", "chunk_no", "kind")


@query(sql("turns", "SELECT conv_id, CAST(chunk_no AS BIGINT) AS chunk_no, CASE WHEN chunk_no % 3 = 0 THEN 'partial' ELSE 'chunk' END AS kind FROM chunked WHERE chunk_no % 2 = 0 OR chunk_no % 3 = 0", CHUNKED))
def j3_partial_wins(spark, sf_dir):
    return chunks.reconcile(*_partials(chunk_rows(spark, sf_dir)), partial_wins=True).select("conv_id", "chunk_no", "kind")


GAPS = "SELECT DISTINCT CAST(chunk_no AS BIGINT) AS chunk_no FROM chunked WHERE chunk_no % 4 = 1 AND chunk_no < (SELECT max(chunk_no) FROM chunked WHERE chunk_no % 4 <> 1)"


@query(sql("turns", GAPS, CHUNKED))
def j4_missing_chunks(spark, sf_dir):
    return chunks.missing(chunk_rows(spark, sf_dir).where("chunk_no % 4 <> 1").select("chunk_no").distinct())


@query(sql("turns", "SELECT CAST(i AS BIGINT) AS chunk_no FROM range(0, 1 + (SELECT max(chunk_no) + 3 FROM chunked)) AS r(i) WHERE i % 4 = 1 OR i > (SELECT max(chunk_no) FROM chunked)", CHUNKED))
def u4_set_difference(spark, sf_dir):
    """Numbers of the chunks expected, three more than there are, less those present."""
    every = chunk_rows(spark, sf_dir).select("chunk_no").distinct()
    last = every.agg(F.max("chunk_no")).first()[0]
    return chunks.expected_less_present(every.where("chunk_no % 4 <> 1"), 0, last + 3)


@query(sql("turns", "SELECT split, conv_id, turn, text FROM turns"))
def u1_union_of_splits(spark, sf_dir):
    t = base.turns(spark, sf_dir)
    parts = [t.where(F.col("split") == name) for name, _ in io.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("split", "conv_id", F.col("turn").cast("long"), "text")


def _files(spark, sf_dir) -> DataFrame:
    """Chunk files written by Spark, one row a file, seen through two overlapping globs."""
    path = scratch(spark, "files")
    io.write_chunks(chunk_rows(spark, sf_dir), path)
    number = F.regexp_extract("path", r"chunk_no=(\d+)", 1).cast("long")
    rows = io.inventory(spark, f"{path}/*", f"{path}/split=train/*")
    return rows.select("path", F.regexp_extract("path", r"split=(\w+)", 1).alias("directory"), number.alias("number"), "bytes").where(F.col("path").endswith(".parquet"))


@query(sql("turns", "SELECT split AS directory, count(DISTINCT chunk_no) AS files FROM chunked GROUP BY 1", CHUNKED))
def s11_u3_inventory(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("directory").agg(F.count_distinct("number").alias("files"))


NAMES = "CASE chunk_no % 4 WHEN 0 THEN 'chunk_' || chunk_no || '.pt' WHEN 1 THEN 'partial_' || chunk_no || '.pt' WHEN 2 THEN 'lines_' || chunk_no || '.jsonl' ELSE 'all_' || chunk_no || '.pt' END"


@query(sql("turns", f"SELECT {NAMES} AS name, CASE chunk_no % 4 WHEN 0 THEN 'chunk' WHEN 1 THEN 'partial' WHEN 2 THEN 'raw' ELSE 'merged' END AS kind, CAST(CASE WHEN chunk_no % 4 < 2 THEN chunk_no END AS INTEGER) AS number, CAST(n AS BIGINT) AS bytes, 'd' || chunk_no % 2 AS directory FROM (SELECT CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n FROM chunked GROUP BY 1)", CHUNKED))
def s11_file_kinds(spark, sf_dir):
    """Files of all kinds, as many bytes long as their chunk has dialogues, through two overlapping globs."""
    path, names = scratch(spark, "kinds"), chunk_rows(spark, sf_dir).groupBy("chunk_no").agg(F.count("*").alias("n"))
    rows = names.select(F.concat(F.lit("d"), (F.col("chunk_no") % 2).cast("string"), F.lit("/"), F.expr(NAMES)).alias("name"), "n")

    def put(batches):
        from dialoom.sources.shared import opened

        for b in batches:
            for name, n in zip(b.column("name").to_pylist(), b.column("n").to_pylist()):
                system, root = opened(path)
                system.create_dir(f"{root}/{name.split('/')[0]}", recursive=True)
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(b"x" * n)
            yield b.select(["name"])

    rows.mapInArrow(put, "name string").agg(F.count("*")).collect()
    found = io.inventory(spark, f"{path}/*", f"{path}/d1/*")
    return found.select("name", "kind", "number", "bytes", F.element_at(F.split("directory", "/"), -1).alias("directory"))


@query(sql("turns", "SELECT split AS directory, CAST(min(chunk_no) AS BIGINT) AS first, CAST(max(chunk_no) AS BIGINT) AS last, max(chunk_no) - min(chunk_no) + 1 = count(DISTINCT chunk_no) AS contiguous FROM chunked GROUP BY ROLLUP (split)", CHUNKED))
def a12_directory_report(spark, sf_dir):
    return quality.directory_report(_files(spark, sf_dir)).select("directory", "first", "last", "contiguous")


@query(sql("steps", "SELECT source AS directory, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(min(doc_id) AS BIGINT) AS first, CAST(max(doc_id) AS BIGINT) AS last, max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) AS contiguous FROM documents GROUP BY ROLLUP (source)"))
def a12_source_report(spark, sf_dir):
    return quality.directory_report(load(spark, sf_dir, "documents").select(F.col("source").alias("directory"), F.col("doc_id").cast("long").alias("number"), F.col("n_chars").cast("long").alias("bytes")))


@query(r"SELECT doc_id, TRY_CAST(regexp_extract(name, '(?:^|/)(?:chunk|partial)_(\d+)\.[^/]*$', 1) AS INTEGER) AS number FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'chunk_x.pt' ELSE 'a/chunk_' || doc_id || '.pt' END AS name FROM documents)")
def f15_chunk_number(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", quality.chunk_number(F.when(F.col("doc_id") % 5 == 0, "chunk_x.pt").otherwise(F.concat(F.lit("a/chunk_"), F.col("doc_id").cast("string"), F.lit(".pt")))).alias("number"))


@query(sql("steps", "SELECT t.split, t.raw, e.encoded, m.merged, t.raw - e.encoded AS lost, e.encoded - m.merged AS unmerged FROM (SELECT split, count(DISTINCT conv_id) AS raw FROM turns GROUP BY 1) t JOIN (SELECT split, count(DISTINCT conv_id) AS encoded FROM steps GROUP BY 1) e USING (split) JOIN (SELECT split, count(*) AS merged FROM chunked WHERE chunk_no >= 1 GROUP BY 1) m USING (split)", CHUNKED))
def j6_count_reconciliation(spark, sf_dir):
    once = lambda df: df.select("split", "conv_id").distinct()
    return quality.count_reconciliation(once(base.turns(spark, sf_dir)), once(base.steps(spark, sf_dir)), chunk_rows(spark, sf_dir).where("chunk_no >= 1"))


@query(sql("steps", "SELECT conv_id, CAST(step AS BIGINT) AS step, 'target' AS what FROM steps WHERE list_contains(target, 3)"))
def j7_encodings_compared(spark, sf_dir):
    """The encoding against one whose unknown words have another id."""
    s = base.steps(spark, sf_dir)
    other = s.withColumn("target", F.transform("target", lambda x: F.when(x == 3, 9).otherwise(x)))
    return quality.differences(s, other).select("conv_id", F.col("step").cast("long"), "what")


@query(sql("turns", "SELECT DISTINCT split, conv_id FROM turns WHERE conv_id % 4 <> 0"))
def j8_source_kept(spark, sf_dir):
    return quality.source_kept(base.turns(spark, sf_dir).select("split", "conv_id").distinct(), base.steps(spark, sf_dir).where("conv_id % 4 <> 0"))


@query(sql("turns", "SELECT DISTINCT split, conv_id FROM turns WHERE conv_id % 4 = 0"))
def j8_source_rejected(spark, sf_dir):
    return quality.source_kept(base.turns(spark, sf_dir).select("split", "conv_id").distinct(), base.steps(spark, sf_dir).where("conv_id % 4 <> 0"), kept=False)


@query(sql("steps", "SELECT split, round(avg(CASE WHEN x_t IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, bool_or(x_t IS NULL) AS newer FROM (SELECT split, CASE WHEN split <> 'test' AND (k < 1 OR conv_id % 4 = 1) THEN NULL ELSE x_t END AS x_t FROM steps, range(2) AS r(k) WHERE split <> 'test' OR k = 1) GROUP BY split"))
def a13_think_share(spark, sf_dir):
    """A think step before each step, some previous utterances lost, and the older format in one split."""
    s = encode.with_thinking(base.steps(spark, sf_dir), 1)
    newer = F.col("split") != "test"
    s = s.where(newer | (F.col("gate") == 1)).withColumn("x_t", F.when(newer & (F.col("conv_id") % 4 == 1), None).otherwise(F.col("x_t")))
    return quality.think_share(s)


@query(sql("steps", "SELECT len(target) AS length, count(*) AS n FROM steps GROUP BY 1"))
def a14_target_lengths(spark, sf_dir):
    return quality.target_lengths(base.steps(spark, sf_dir))


@query(sql("steps", "SELECT t.idx, coalesce(word, 'UNK') AS word, n FROM (SELECT idx, count(*) AS n FROM (SELECT unnest(target)::BIGINT AS idx FROM steps) WHERE idx NOT IN (0, 2) GROUP BY 1 ORDER BY n DESC, idx LIMIT 10) t LEFT JOIN (SELECT idx, word FROM vocab) v USING (idx)"))
def a14_target_words(spark, sf_dir):
    return quality.target_words(base.steps(spark, sf_dir), vocab.decode_table(base.vocabulary(spark, sf_dir))).select(F.col("idx").cast("long"), "word", "n")


@query(sql("steps", "SELECT round(max(n) / sum(n), 6) AS modal_share, round(coalesce(sum(n) FILTER (len(target) = 2), 0) / sum(n), 6) AS one_word_share FROM (SELECT target, count(*) AS n FROM steps GROUP BY 1)"))
def a14_degenerate_share(spark, sf_dir):
    return quality.degenerate_share(base.steps(spark, sf_dir))


@query(sql("steps", f"SELECT CAST(batch_no AS BIGINT) AS batch_no, CAST(row AS BIGINT) AS row, array_to_string(list_resize(x_ref, max(len(x_ref)) OVER (PARTITION BY batch_no), 0), ' ') AS x_ref FROM dlg", BATCHED))
def x4_f9_reference(spark, sf_dir):
    d, _ = batched(spark, sf_dir)
    return batches.collate_reference(d).select("batch_no", "row", rendered(F.col("x_ref")).alias("x_ref"))


COLLATED = ("collated", "SELECT d.batch_no, f.step, d.row, coalesce(s.x_t, []) AS x_t, coalesce(s.target, []) AS target, coalesce(s.gate, 0.0) AS gate FROM dlg d JOIN (SELECT batch_no, unnest(range(0, max(step) + 1)) AS step FROM dlg JOIN steps USING (conv_id) GROUP BY batch_no) f USING (batch_no) LEFT JOIN steps s ON s.conv_id = d.conv_id AND s.step = f.step")


@query(sql("steps", "SELECT CAST(batch_no AS BIGINT) AS batch_no, CAST(step AS BIGINT) AS step, CAST(row AS BIGINT) AS row, CASE WHEN max(len(x_t)) OVER w > 0 THEN array_to_string(list_resize(x_t, max(len(x_t)) OVER w, 0), ' ') END AS x_t, CASE WHEN max(len(target)) OVER w > 0 THEN array_to_string(list_resize(target, max(len(target)) OVER w, 0), ' ') END AS target, gate::DOUBLE AS gate FROM collated WINDOW w AS (PARTITION BY batch_no, step)", BATCHED, COLLATED))
def x4_collated_batches(spark, sf_dir):
    out = batches.collate(*batched(spark, sf_dir))
    return out.select("batch_no", F.col("step").cast("long"), "row", rendered(F.col("x_t")).alias("x_t"), rendered(F.col("target")).alias("target"), "gate")


@query(sql("steps", "SELECT CAST(batch_no AS BIGINT) AS batch_no, CAST(row AS BIGINT) AS row, CAST(sum(len(target)) AS BIGINT) AS tokens, CAST(max(max(len(target))) OVER (PARTITION BY batch_no) AS BIGINT) AS longest, arg_max(array_to_string(target, ' '), step) AS last FROM dlg JOIN steps USING (conv_id) GROUP BY batch_no, row", BATCHED))
def ucollate_hook(spark, sf_dir):
    """Batches by another function: a row a dialogue, with its tokens, the batch's longest target and its last target."""

    def own(batch):
        import pandas as pd

        batch["n"] = batch.target.map(len)
        rows = batch.groupby("row")
        last = rows.target.last().map(lambda t: " ".join(map(str, t)))
        return pd.DataFrame({"batch_no": batch.batch_no.iloc[0], "row": last.index, "tokens": rows.n.sum(), "longest": batch.n.max(), "last": last})

    return batches.collate_with(*batched(spark, sf_dir), own, "batch_no long, row long, tokens long, longest long, last string")


@query(sql("steps", "SELECT conv_id, CAST(step AS BIGINT) AS step, CAST(len(target) AS BIGINT) AS length, array_to_string(list_transform(target, lambda x: CASE WHEN x = 2 THEN 0 ELSE x END), ' ') AS masked, CAST(target[1] AS BIGINT) AS first_label, len(target) > 1 AS supervised FROM steps"))
def f10_f11_masks(spark, sf_dir):
    s, masked = base.steps(spark, sf_dir), A.without_end(F.col("target"))
    return s.select("conv_id", F.col("step").cast("long"), A.true_length(F.col("target")).cast("long").alias("length"), rendered(masked).alias("masked"), A.first_label(F.col("target")).cast("long").alias("first_label"), A.has_target(masked).alias("supervised"))


@query(sql("steps", "SELECT conv_id, max_by(array_to_string(target, ' '), step) AS final FROM steps GROUP BY conv_id"))
def w5_final_target(spark, sf_dir):
    return batches.final_target(base.steps(spark, sf_dir)).select("conv_id", rendered(F.col("final")).alias("final"))


@query(sql("steps", "SELECT conv_id, max_by(array_to_string(target, ' '), step) AS final FROM steps WHERE len(target) > 1 GROUP BY conv_id"))
def w5_final_with_tokens(spark, sf_dir):
    s = base.steps(spark, sf_dir).withColumn("target", F.when(F.size("target") > 1, F.col("target")).otherwise(F.array(F.lit(0))))
    return batches.final_target(s, with_tokens=True).select("conv_id", rendered(F.col("final")).alias("final")).where("final is not null")


PLAN = ("plan", "SELECT conv_id, unnest(range(least(greatest(max(step) + 1, 3), 6))) AS step FROM steps GROUP BY conv_id")


@query(sql("steps", "SELECT p.conv_id, CAST(p.step AS BIGINT) AS step, CASE WHEN p.step = 4 AND s.target IS NULL THEN f.final ELSE array_to_string(s.target, ' ') END AS target FROM plan p LEFT JOIN steps s USING (conv_id, step) LEFT JOIN (SELECT conv_id, max_by(array_to_string(target, ' '), step) AS final FROM steps GROUP BY 1) f USING (conv_id)", PLAN))
def x5_step_plan(spark, sf_dir):
    out = batches.extended(base.steps(spark, sf_dir), 3, 6, to_most=False, safety=5)
    return out.select("conv_id", F.col("step").cast("long"), rendered(F.col("target")).alias("target"))


@query(sql("steps", "SELECT p.conv_id, CAST(p.step AS BIGINT) AS step, CASE WHEN p.step = 4 AND s.target IS NULL THEN f.final ELSE array_to_string(s.target, ' ') END AS target FROM (SELECT conv_id, unnest(range(6)) AS step FROM steps GROUP BY conv_id) p LEFT JOIN steps s USING (conv_id, step) LEFT JOIN (SELECT conv_id, max_by(array_to_string(target, ' '), step) AS final FROM steps GROUP BY 1) f USING (conv_id)"))
def x5_step_plan_to_most(spark, sf_dir):
    """Every plan goes on to the most steps there may be."""
    out = batches.extended(base.steps(spark, sf_dir), 3, 6, to_most=True, safety=5)
    return out.select("conv_id", F.col("step").cast("long"), rendered(F.col("target")).alias("target"))


@query(sql("steps", "SELECT conv_id, CAST(step AS BIGINT) AS step, CASE WHEN conv_id % 5 = 0 THEN array_to_string(x_ref, ' ') WHEN conv_id % 5 = 1 THEN '1 2' ELSE array_to_string(x_t, ' ') END AS context, CAST(j AS BIGINT) AS j, CASE WHEN j > 0 THEN array_to_string(target[1:j], ' ') END AS prefix, CAST(target[j + 1] AS BIGINT) AS gold FROM (SELECT conv_id, step, x_ref, x_t, target, unnest(range(len(target))) AS j FROM steps)"))
def x6_p12_f12_forced_rows(spark, sf_dir):
    """Some dialogues lack the previous utterance, which leaves the reference, and some have padding in its place."""
    c = F.col("conv_id") % 5
    s = base.steps(spark, sf_dir).withColumn("x_t", F.when(c == 0, None).when(c == 1, F.array(F.lit(0), F.lit(0))).otherwise(F.col("x_t")))
    out = batches.forced_rendered(s)
    return out.select("conv_id", F.col("step").cast("long"), "context", F.col("j").cast("long"), "prefix", F.col("gold").cast("long"))


@query(sql("steps", "SELECT conv_id, CAST(step AS BIGINT) AS step FROM steps WHERE len(target) >= 6"))
def p13_short_targets(spark, sf_dir):
    return batches.short_targets(base.steps(spark, sf_dir), 6).select("conv_id", F.col("step").cast("long"))


KEY = "(conv_id * 7919 + 13) % 10007"


@query(sql("steps", f"SELECT conv_id, CAST(step AS BIGINT) AS step FROM (SELECT *, len(target) < 100 AS short, row_number() OVER (PARTITION BY split, len(target) < 100 ORDER BY {KEY}, conv_id, step) AS r FROM steps) WHERE NOT short OR r <= 7"))
def p13_quota(spark, sf_dir):
    """All steps of a hundred target tokens or more, and exactly seven shorter ones of each split."""
    key = F.struct("conv_id", "step")
    out = batches.short_targets(base.stored(base.steps(spark, sf_dir), "steps"), 100, keep=7, by=("split",), key=key, order=F.expr(KEY), width=64)
    return out.select("conv_id", F.col("step").cast("long"))


@query(sql("steps", f"SELECT conv_id, CAST(step AS BIGINT) AS step FROM (SELECT *, len(target) < 100 AS short, row_number() OVER (PARTITION BY split, len(target) < 100 ORDER BY {KEY}, conv_id, step) AS r, count(*) OVER (PARTITION BY split, len(target) < 100) AS n FROM steps) WHERE NOT short OR r <= floor(n * 0.3)"))
def p13_share(spark, sf_dir):
    """All steps of a hundred target tokens or more, and three tenths of the shorter ones of each split."""
    out = batches.short_targets(base.stored(base.steps(spark, sf_dir), "steps"), 100, keep_share=0.3, by=("split",), key=F.struct("conv_id", "step"), order=F.expr(KEY), width=64)
    return out.select("conv_id", F.col("step").cast("long"))


@query(sql("turns", f"SELECT CAST(row_number() OVER (ORDER BY chunk_no, {KEY}, conv_id) AS BIGINT) AS place, conv_id FROM chunked", CHUNKED))
def t5_shuffled_chunks(spark, sf_dir):
    """The order inside each chunk by a repeatable key; places are numbered chunk by chunk."""
    rows = chunks.shuffled(chunk_rows(spark, sf_dir), F.col("conv_id"), by=F.expr(KEY))
    return rows.select((F.col("chunk_no") * SIZE + F.col("place") + 1).alias("place"), "conv_id")


@query(sql("turns", f"SELECT conv_id FROM chunked ORDER BY chunk_no, {KEY}, conv_id LIMIT 25", CHUNKED))
def t6_sample_by_chunk(spark, sf_dir):
    return batches.sample(chunk_rows(spark, sf_dir), 25, F.struct(F.expr(KEY), "conv_id"), by_chunk=True).select("conv_id")


@query(sql("turns", f"SELECT conv_id FROM chunked ORDER BY {KEY}, conv_id LIMIT 25", CHUNKED))
def t6_sample_global(spark, sf_dir):
    return batches.sample(chunk_rows(spark, sf_dir), 25, F.struct(F.expr(KEY), "conv_id"), by_chunk=False).select("conv_id")


@query(sql("turns", "SELECT DISTINCT CAST(chunk_no AS BIGINT) AS chunk_no, 'chunk_' || chunk_no || '.pt' AS name FROM chunked", CHUNKED))
def t3_numeric_order(spark, sf_dir):
    names = chunk_rows(spark, sf_dir).select(F.concat(F.lit("chunk_"), F.col("chunk_no").cast("string"), F.lit(".pt")).alias("name")).distinct()
    return names.select(quality.chunk_number(F.col("name")).cast("long").alias("chunk_no"), "name").orderBy("chunk_no")


@query(sql("turns", "SELECT conv_id, CAST(chunk_no AS BIGINT) AS chunk_no FROM chunked WHERE n >= 15", CHUNKED))
def p11_resume(spark, sf_dir):
    """Rows from the fifteenth on."""
    return chunk_rows(spark, sf_dir).where(F.col("chunk_no") * SIZE + F.col("pos") >= 15).select("conv_id", "chunk_no")


def _latest(spark, stream, build, keys: list[str]) -> DataFrame:
    """Run an aggregation of a stream to its end; each batch's changed rows go to the shared folder, and the last of
    each key counts. Nothing comes to the driver."""
    path, out = scratch(spark, "updates"), build(stream)
    schema = out.schema

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")  # a batch that runs again replaces itself

    spark.createDataFrame([], schema).write.parquet(f"{path}/batch_id=-1")
    out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    rows, rest = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, batch_id long").parquet(path), [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch_id").alias(c) for c in rest))


def _conversations(spark, sf_dir) -> DataFrame:
    """A stream of the conversations; the pattern has one match, the table itself."""
    return spark.readStream.schema(load(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque[t]")


@query(sql("cnt", "SELECT word, CAST(n AS BIGINT) AS n FROM cnt"))
def st5_running_counts(spark, sf_dir):
    return _latest(spark, _conversations(spark, sf_dir), live.running_counts, ["word"]).select("word", F.col("count").alias("n"))


@query(sql("", "SELECT role AS split, CAST(count(*) AS BIGINT) AS steps, CAST(sum(length(text)) AS DOUBLE) AS loss_sum FROM conversations GROUP BY 1"))
def st6_running_metrics(spark, sf_dir):
    out = _latest(spark, _conversations(spark, sf_dir), lambda s: live.running_metrics(s.select(F.col("role").alias("split"), F.length("text").cast("double").alias("loss"))), ["split"])
    return out.select("split", "steps", "loss_sum")


@query(sql("ids", "SELECT array_to_string(list_transform(list(ids ORDER BY turn), lambda x: array_to_string(x, ' ')), ' | ') AS ids FROM ids GROUP BY split, conv_id"))
def st1_st2_live_encode(spark, sf_dir):
    """The dialogues as JSONL files, encoded by the live stream in two runs: the second goes on where the first ended."""
    from dialoom.plans.corpus import write_dialogues

    paths = write_dialogues(spark, sf_dir, "utterance")
    source, target, state = scratch(spark, "incoming"), scratch(spark, "live"), scratch(spark, "offsets")
    own = io.encoder(base.stored(base.vocabulary(spark, sf_dir), "vocabulary"))
    for names in (["train"], ["valid", "test"]):  # files that come while nothing runs
        for name in names:
            if io.exists(spark, paths[name]):
                spark.read.text(paths[name]).write.mode("append").text(source)
        live.live_encode(spark, source, target, state, own, max_files=2, block=SIZE).awaitTermination()
    shown = F.concat(F.array(rendered(F.col("x_ref"))), F.transform("steps", lambda s: rendered(s["target"])))
    return spark.read.parquet(target).select(F.array_join(shown, " | ").alias("ids"))


def _append(lines: DataFrame, folder: str, files: int) -> None:
    """Append lines (value, key, torn) to so many files of a folder, a task a file, as a logger would. Of a torn line, which
    has to be its file's last one, only the first half is written; the next call writes the rest first."""

    def put(batches):
        import pyarrow as pa

        from dialoom.sources.shared import opened

        for b in batches:
            for k in sorted(set(b.column("file").to_pylist())):
                system, root = opened(folder)
                system.create_dir(root)
                path = f"{root}/live_{k}.jsonl"
                with system.open_append_stream(path) as out:
                    rows = zip(*(b.column(c).to_pylist() for c in ("file", "value", "torn")))
                    out.write("".join(v[: len(v) // 2] if torn else v + "\n" for f, v, torn in rows if f == k).encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    dealt = lines.withColumn("file", F.pmod(F.col("key"), F.lit(files)).cast("int")).repartition(files, "file").sortWithinPartitions("file", "key")
    dealt.select("file", "value", "torn").mapInArrow(put, "n long").agg(F.sum("n")).collect()


@query(sql("ids", "SELECT CAST(conv_id % 3 AS INTEGER) AS file, CAST(row_number() OVER (PARTITION BY conv_id % 3 ORDER BY round, conv_id) - 1 AS BIGINT) AS line_no, array_to_string(list_transform(list(ids ORDER BY turn), lambda x: array_to_string(x, ' ')), ' | ') AS ids FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END AS round FROM ids) GROUP BY split, conv_id, round"))
def st1_st2_growing_file(spark, sf_dir):
    """Three files grow: half of the dialogues and a torn line, then its rest and the other half; each run of the live
    stream goes on where the one before it stopped."""
    turns = base.turns(spark, sf_dir)
    lines = base.stored(turns.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text")))).alias("value")), "dialogues")
    source, target, state = scratch(spark, "growing"), scratch(spark, "live"), scratch(spark, "offsets")
    own = io.encoder(base.stored(base.vocabulary(spark, sf_dir), "vocabulary"))
    first, second = lines.where("conv_id % 2 = 0"), lines.where("conv_id % 2 = 1")
    file = F.col("conv_id") % 3
    last = first.groupBy(file.alias("file")).agg(F.max("conv_id").alias("last"))
    first = first.withColumn("file", file).join(F.broadcast(last), "file").withColumn("torn", F.expr("conv_id = last"))  # three rows
    rest = first.where("torn").select(F.expr("substr(value, length(value) div 2 + 1)").alias("value"), F.col("file").alias("key"), F.lit(False).alias("torn"))
    for grown in (first.select("value", F.col("conv_id").alias("key"), "torn"), rest, second.select("value", F.col("conv_id").alias("key"), F.lit(False).alias("torn"))):
        _append(grown, source, 3)
        live.live_encode_growing(spark, source, target, state, own, block=SIZE).awaitTermination()
    shown = F.concat(F.array(rendered(F.col("x_ref"))), F.transform("steps", lambda s: rendered(s["target"])))
    return spark.read.parquet(target).select(F.regexp_extract("file_name", r"_(\d+)\.", 1).cast("int").alias("file"), "line_no", F.array_join(shown, " | ").alias("ids"))


@query(sql("turns", "SELECT CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n, true AS in_order FROM chunked GROUP BY 1", CHUNKED))
def st3_numbered_chunks(spark, sf_dir):
    """Every third chunk and the first come last; all are emitted in the order of their numbers, four a batch at most."""
    tasks = spark.sparkContext.defaultParallelism
    path, target, state = scratch(spark, "numbered"), scratch(spark, "followed"), scratch(spark, "offsets")
    rows = base.stored(chunk_rows(spark, sf_dir).select("chunk_no", "conv_id"), "chunks")
    late = F.col("chunk_no") % 3 == 0

    def put(batch: DataFrame, number: int) -> None:
        remove(f"{target}/batch_id={number}")  # a batch that runs again replaces itself
        io.write_small(batch.withColumn("batch_id", F.lit(number)), target, "batch_id")

    for part in (rows.where(~late), rows.where(late)):
        io.write_small(part.repartition(tasks, "chunk_no").sortWithinPartitions("chunk_no"), path, "chunk_no")
        stream = live.follow_numbered(spark, path, "chunk_no long, conv_id long", state, chunks_per_trigger=4)
        live.drained(stream.writeStream.foreachBatch(put), state)
    found = spark.read.schema("chunk_no long, conv_id long, batch_id long").parquet(target)
    sums = base.stored(found.groupBy("chunk_no").agg(F.count("*").alias("n"), F.min("batch_id").alias("a"), F.max("batch_id").alias("z")), "followed")
    spans = sums.groupBy(F.col("z").alias("batch")).agg(F.min("chunk_no").alias("low"), F.max("chunk_no").alias("high"))
    before = F.coalesce(F.max("high").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))  # a row a batch
    ordered = spans.withColumn("ok", (F.col("low") > before) & (F.col("high") - F.col("low") < 4))
    return sums.join(ordered, F.col("z") == F.col("batch")).select("chunk_no", "n", (F.col("ok") & (F.col("a") == F.col("z"))).alias("in_order"))


@query(sql("turns", "SELECT CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n FROM chunked GROUP BY 1", CHUNKED))
def st3_st4_follow_chunks(spark, sf_dir):
    """Chunk files followed two at a time."""
    path = scratch(spark, "follow")
    chunk_rows(spark, sf_dir).select("chunk_no", "conv_id").repartitionByRange(8, "chunk_no").write.parquet(path)
    stream = live.follow_chunks(spark, path, "chunk_no long, conv_id long", files_per_trigger=2)
    return _latest(spark, stream, lambda s: s.groupBy("chunk_no").agg(F.count("*").alias("n")), ["chunk_no"])
