"""Column names with dots, ids that repeat, arrays that workers map."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import decontaminate, linedup, simhash, toxicity, warc
from dialoom.llm.common import load_arrays, save_arrays
from dialoom.llm.queries import ORACLES, QUERIES


def test_filters_keep_columns_of_any_name(spark):
    rows = [(1, "one two three four five\nsame line again", 7, "x"), (2, "same line again", 8, None), (3, None, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` int, `c0` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    for made, kept in ((toxicity.keep_clean(docs, labels, threshold=2.0), {1, 2, 3}), (decontaminate.clean(docs, items), {2, 3}), (linedup.deduplicated(docs), {1, 2, 3}), (simhash.keep_first(docs), {1, 2, 3})):
        got = {r[0]: (r[2], r[3]) for r in made.collect()}
        assert made.columns == docs.columns and made.schema["a.b"].dataType == docs.schema["a.b"].dataType
        assert got == {i: (n, s) for i, _, n, s in rows if i in kept}


def test_ids_that_repeat_keep_a_record_each(spark, tmp_path):
    a, b, c = "a" * 120, "b" * 150, "short"
    pages = [(1, "u", a), (1, "v", b), (5, "w", b), (6, "x", a), (7, "y", c), (7, "y", c), (1, "u", a), (None, "n", b)]
    warc.write(warc.plan_records(spark.createDataFrame(pages, "page_id bigint, url string, html string")), f"file://{tmp_path}/w")
    got = sorted((r.page_id or -1, r.uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(warc.read(spark, f"file://{tmp_path}/w")).collect())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i or -1, u, len(x), digest(x), "revisit" if i in (5, 6) else "response", 1 if i in (5, 6) else None) for i, u, x in pages if i is not None]
    assert [g for g in got if g[0] > 0] == sorted(want)
    assert [g[2:4] for g in got if g[0] < 0] == [(150, digest(b))]


def test_arrays_are_mapped(tmp_path):
    arrays = {"a": np.arange(10), "b": np.zeros((3, 0)), "c": np.asarray([[1.5, -2]])}
    save_arrays(f"file:{tmp_path}/x", arrays)
    got = load_arrays(f"file://{tmp_path}/x", list(arrays))
    assert all((got[n] == x).all() and got[n].dtype == x.dtype and got[n].shape == x.shape for n, x in arrays.items())
    assert isinstance(got["a"].base, np.memmap) or got["a"].base is not None


def test_one_index_serves_both_scores(spark):
    """The index that tasks map gives what one built in this process gives."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, 12)) + (" bad" if k % 3 == 0 else "")) for k in range(90)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    shared, _ = toxicity.fit(docs, labels)
    model = shared.value
    rows, terms, counts = toxicity.term_counts(docs.sort("doc_id").toArrow()["text"].combine_chunks(), model.vocabulary)
    again = toxicity.built(np.bincount(rows, minlength=90), terms, counts, model.weight)
    assert all((getattr(model.index, n) == getattr(again, n)).all() for n in toxicity.Index.ARRAYS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
