"""The registered queries on the smallest tables, against their contracts, and the pipeline stage by stage."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dialoom.llm.queries import QUERIES
from dialoom.llm import packing, toxicity
from tests.llm.test_operators import fingerprint, groups_of, line_links, line_removals, tiling, words


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}


def run(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_op1(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op1_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_op2(spark, sf_dir, docs):
    fps = {i: fingerprint(t) for i, t in docs.items()}
    want = groups_of(fps, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, sf_dir, "op2_simhash")} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_op3(spark, sf_dir, pages):
    import html
    import re

    got = {r.page_id: r for r in run(spark, sf_dir, "op3_html_extract")}
    for i, p in pages.items():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        text = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if x)
        assert (got[i].url, got[i].text, got[i].n_chars) == (p.url, text, len(text))


def test_op4(spark, sf_dir, docs):
    want = line_removals(docs.items())
    got = {r.doc_id: r for r in run(spark, sf_dir, "op4_line_dedup")}
    assert got.keys() == docs.keys() and {(i, x.line_no): (x.to_doc_id, x.to_line_no) for i, r in got.items() for x in r.removed or []} == want
    links = line_links(docs.items())
    assert all(r.n_removed == len(r.removed or []) and (r.n_links, r.class_id) == links.get(i, (0, i)) for i, r in got.items())


def test_op5(spark, sf_dir, docs):
    toks = {i: [*words(t), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(x for i in docs if not held[i] for x in toks[i])
    n, v = sum(c.values()), len(c)
    got = run(spark, sf_dir, "op5_lm_score")
    assert len(got) == len(docs)
    for r in got:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op6(spark, sf_dir, pages):
    first = {}
    for i, p in sorted(pages.items()):
        first.setdefault((p.html or "").encode(), i)
    got = {r.page_id: r for r in run(spark, sf_dir, "op6_warc_salvage")}
    assert len(got) == len(pages)
    for i, p in pages.items():
        raw = (p.html or "").encode()
        again = len(raw) >= 100 and first[raw] != i
        assert tuple(got[i][:5]) == (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None)


def test_op7(spark, sf_dir, docs):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op7_media_columns")}
    by_text = {}
    for i, t in docs.items():
        raw, r = (t or "").encode(), got[i]
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = b"P6\n64 %d\n255\n" % (len(padded) // 192) + padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert by_text.setdefault(t, r.feature) == r.feature


def test_op8(spark, sf_dir, docs):
    hits = Counter((r.doc_id, r.license) for r in run(spark, sf_dir, "op8_license_scan"))
    for i, t in docs.items():
        for name, line in (("MIT-short", "Released under the MIT License."), ("Apache-2.0-short", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0-short", "This work is licensed under the GNU General Public License, version 3.")):
            assert hits[i, name] >= t.count(line)


def test_op9(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_files()[0])
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs.items()}
    at, fill = Counter(), Counter()
    for r in sorted(run(spark, sf_dir, "op9_packing"), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.asarray(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    assert at == {i: len(x) for i, x in want.items()} and max(fill.values()) <= 2048
    padding = sum(2048 - n for n in fill.values() if n & (n - 1))
    assert padding < 0.01 * sum(at.values())


def leaked(docs, items):
    out = set()
    grams = {k: {tuple(words(x)[j : j + 4]) for j in range(len(words(x)) - 3)} for k, x in items.items()}
    for i, t in docs.items():
        w = words(t)
        own = {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
        for k, x in items.items():
            if len(own & grams[k]) * 4 >= 0.5 * len(words(x)):
                at = [j for j in range(len(w) - 3) if tuple(w[j : j + 4]) in grams[k]]
                near = w[max(0, min(at) - 4) : max(at) + 8]
                if sum(z[2] for z in tiling(near, words(x), 4)) >= 0.5 * len(words(x)):
                    out.add((i, k))
    return out


def test_op10(spark, sf_dir, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {(r.doc_id, r.item_id) for r in run(spark, sf_dir, "op10_decontaminate")} == leaked(docs, items)


def test_pipeline(spark, sf_dir):
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "decontaminate", "packing"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    now, before = start.cache(), {r.doc_id: r.text for r in start.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == start.columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score(start, labels).where(F.col("score") >= 0.7).collect()}
            want = {i: t for i, t in before.items() if i not in bad}
        elif name == "line_dedup":
            gone = line_removals(before.items())
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in now.collect())
        elif name == "simhash":
            group = groups_of({i: fingerprint(t) for i, t in before.items()}, 4)
            want = {i: t for i, t in before.items() if group[i] == i}
        else:
            bad = {i for i, _ in leaked(before, items)}
            want = {i: t for i, t in before.items() if i not in bad}
        assert after == want
        before = after
    lengths = {r.doc_id: r.n for r in corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths.keys() == before.keys()
