"""Vector codes, periodic runs and BPE coding against brute force and the tokenizers library."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialoom.llm import bpe, periodic, vectorcodes
from dialoom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- vector codes ----
def books_of(x, rounds=6):
    """Codebooks and codes by plain k-means over whole numbers."""
    d = x.shape[1] // 8
    books = [x[:16, p * d : (p + 1) * d].copy() for p in range(8)]

    def assigned(p):
        far = ((x[:, None, p * d : (p + 1) * d] - books[p][None]) ** 2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        for p in range(8):
            of, _ = assigned(p)
            for k in set(of.tolist()):
                books[p][k] = x[of == k, p * d : (p + 1) * d].sum(0) // (of == k).sum()
    return np.stack(books), [assigned(p) for p in range(8)]


def codes_of(rows):
    """(vec_id, code, error, label_error, sha) of rows (vec_id, vector, label)."""
    rows = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    books, of = books_of(np.array([[math.floor(4096 * x) for x in v] for _, v, _ in rows], np.int64))
    error, labels = sum(e for _, e in of).tolist(), {}
    for (_, _, label), e in zip(rows, error):
        labels[label] = labels.get(label, 0) + e
    return [(i, "".join(f"{a[j]:02x}" for a, _ in of), error[j], labels[label], sha(",".join(map(str, books.ravel())))) for j, (i, _, label) in enumerate(rows)]


def test_op11(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_vector_codes"](spark, sf_dir).collect())) == sorted(codes_of(rows))


def test_vector_codes_of_odd_rows(spark, monkeypatch):
    """Nulls, values that aren't finite, repeated ids, equal vectors, null labels, clashing names, two partitions."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 2, 16) / 3], int(i % 3) if i % 4 else None) for i in range(60)]
    rows += [rows[5], rows[6], (None, rows[7][1], 1), (61, None, 1), (62, [1.0] * 15 + [None], 1), (63, [float("nan")] * 16, 2), (64, [float("inf")] * 16, 2), (65, [], 0)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "`a.id` long, embedding array<double>, label int, vec_id int, code int").repartition(2)
    for limit in (1_000_000, 1):  # joined by broadcast, and by salted keys
        monkeypatch.setattr(vectorcodes, "LABELS", limit)
        coded, books = vectorcodes.compressed(d, vec_id="a.id")
        got = [(*r, vectorcodes.books_sha256(books)) for r in coded.select("vec_id", "code", "error", "label_error").collect()]
        assert sorted(got, key=str) == sorted(codes_of(rows), key=str)
    back = {r.vec_id: r.vector for r in vectorcodes.decode(coded, books).collect()}
    code = dict(coded.select("vec_id", "code").collect())
    assert back[3] == [x / 4096 for p in range(8) for x in books[p][int(code[3][2 * p : 2 * p + 2], 16)].tolist()]


def test_vector_codes_of_few_and_no_rows(spark):
    rows = [(9, [0.5] * 8, None), (4, [0.25] * 8, 1)]
    coded, books = vectorcodes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert books.shape == (8, 2, 1) and sorted(map(tuple, coded.select("vec_id", "code", "error").collect())) == [(4, "00" * 8, 0), (9, "01" * 8, 0)]
    none, books = vectorcodes.compressed(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error"] and books.shape[1] == 0


def test_vectors_that_can_not_be_coded_are_errors(spark):
    for vectors in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[1e30] * 8]):
        with pytest.raises(Exception, match="one length|too large"):
            vectorcodes.compressed(spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int"))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 16), st.integers(1, 5), st.integers(0, 2**32))
def test_equal_average_search_finds_the_nearest(k, d, seed):
    rng = np.random.default_rng(seed)
    high = int(rng.choice([2, 10, 1 << 20]))
    x, entries = rng.integers(-high, high, (50, d)), rng.integers(-high, high, (k, d))
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    index, best = vectorcodes.nearest(x, entries)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


# ---- periodic runs ----
def runs_of(w, least=6, times=4):
    out, n = {}, len(w)
    for q in range(1, n // times + 1):
        k = 0
        while k < n - q:
            j = k
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - k + q >= max(least, times * q):
                out.setdefault((k, j - k + q), q)
            k = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed_of(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_op12(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for i, text in docs:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_of(w)
        with_runs += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        assert got[i] == (i, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed_of(w, runs)))
    assert with_runs > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=9), st.lists(st.integers(0, 2), min_size=1, max_size=8), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=9), st.integers(2, 4))
def test_runs(head, root, times, tail, least_times):
    w = head + root * times + tail
    number = np.unique(np.asarray(w), return_inverse=True)[1].ravel()
    assert list(zip(*(x.tolist() for x in periodic.all_runs(number, 6, least_times)))) == runs_of(w, 6, least_times)


def test_runs_of_long_texts():
    """Texts on which quadratic work would show: one word, a short period, nested periods, a long stretch twice."""
    n = 60_000
    assert [x.tolist() for x in periodic.all_runs(np.zeros(n, np.int64))] == [[0], [n], [1]]
    assert [x.tolist() for x in periodic.all_runs(np.arange(n) % 7)] == [[0], [n], [7]]
    nested = np.tile([*[0] * 10, 1], n // 11)
    start, length, period = periodic.all_runs(np.unique(nested, return_inverse=True)[1].ravel())
    assert period.max() == 11 and (period == 1).sum() == n // 11 and length[period == 11].tolist() == [n // 11 * 11]
    assert len(periodic.all_runs(np.concatenate([np.arange(n // 2)] * 2))[0]) == 0


def test_periodic_runs_of_odd_rows(spark):
    """Nulls, blanks, other white space, upper case, repeated rows, dotted and clashing names; texts don't touch."""
    texts = [None, "", " \t\n", "a " * 7, "a a a", "A a " * 4, "x\x0by\x1cz " * 6, "q " * 3, "q " * 3, "a b c d " * 4 + "a b"]
    d = spark.createDataFrame([(None if k == 3 else k // 2, t, 1) for k, t in enumerate(texts)], "`an.id` long, text string, runs int").coalesce(1)
    got = periodic.runs(d, doc_id="an.id").collect()
    for (i, found, collapsed), (k, t) in zip(got, enumerate(texts)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert i == (None if k == 3 else k // 2) and [tuple(r) for r in found] == runs_of(w) and collapsed == collapsed_of(w, runs_of(w))
    assert periodic.runs(d.where("false"), doc_id="an.id").count() == 0


# ---- BPE ----
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(PATH)


def ids_of(coder, texts):
    ids, n = coder(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_op13(spark, sf_dir, library):
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_bpe_coding"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


SIGNS = [*" \n\t\r\x0b\x1c\x1f\x7f\x85\xa0 ᠎    　​﻿abZ12'stremld\xe9\xb2中٣\U0001f600.,!<|>-", "<|endoftext|>", "<|endof", "'ll", "  ", "\n\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=30).map("".join), min_size=1, max_size=4))
def test_ids_equal_the_library_s(coder, library, texts):
    assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(coder, library, text):
    assert ids_of(coder, [text, None, text]) == [library.encode(text, add_special_tokens=False).ids, [], library.encode(text, add_special_tokens=False).ids]


def test_ids_of_hard_texts(coder, library):
    texts = ["a" * 5000, "ab" * 3000, "<|endoftext|>" * 50, " " * 3000 + "x", "hello world " * 2000, "aaa aaa\naaa" * 40, "中文" * 800, "xy" * 50]
    assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_chunks_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    coder = bpe.Coder(PATH)
    for texts in (["one two three four five"], ["five four"], ["six one two", "seven"], ["one six five"]):
        assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_of_odd_rows(spark, library):
    """Nulls, repeated rows, dotted and clashing names; unknown ids and broken bytes in decoding; empty tables."""
    d = spark.createDataFrame([(1, None, 0), (1, "a b", 0), (1, "a b", 0), (None, "", 0)], "`d.id` long, text string, ids int")
    got = bpe.decode(bpe.encode(d, PATH, doc_id="d.id"), PATH).collect()
    ab = library.encode("a b").ids
    assert sorted(map(tuple, got), key=str) == sorted([(1, [], ""), (1, ab, "a b"), (1, ab, "a b"), (None, [], "")], key=str)
    half = library.encode("中").ids[:1]
    lists = [[99_999_999, *ab, -5], None, half, [50256], [50256, *half, *ab], [ab[0], None]]
    back = bpe.decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>"), PATH)
    want = [library.decode([i for i in l or [] if i is not None and 0 <= i < 50257], skip_special_tokens=False) for l in lists]
    assert [r.text for r in back.sort("doc_id").collect()] == want
    assert bpe.encode(d.where("false"), PATH, doc_id="d.id").count() == 0 and back.where(F.lit(False)).count() == 0
