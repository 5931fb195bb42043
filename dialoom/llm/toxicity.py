"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (lower-cased, ASCII punctuation stripped from their ends) and their openings of 6 characters, which
carry over to inflections that no example has. All terms of a bounded sample of labelled rows (`sample` rows, smallest
hash first; all rows where there are fewer) count, and every sampled row with a word is an example of either label. A
term's weight is (1 + ln tf) * idf * rf: idf = 0.1 + ln((1 + N) / (1 + df)) over all documents, and the relevance
frequency rf = log2(2 + a / max(1, b)) of a toxic and b other examples with the term (`relevance=False`: 1, plain TF-IDF).
Vectors are scaled to length 1 over all terms of the sample.

Search is exact in an inverted index cut in blocks of examples: postings of rare terms are added up, the commonest terms
are columns of a matrix with each block's largest weight; a block is visited for those texts of a batch whose upper bound
reaches their k-th best so far. Neighbours vote with weight 1 / (1 - cosine + 0.1); one further vote for the base rate
keeps thin evidence near it. Leave-one-out votes of the sample, made monotone (pool adjacent violators with one added
count a class, straight lines between pools), turn votes into probabilities.

Defined results: a null or empty text, like any text without a term of the sample, has no neighbour and gets the rate of
such examples; ties between neighbours go to the smaller id; repeated rows score alike; null labels are left out, a
document labelled twice counts as toxic if either says so, and of texts that share an id the least is the example;
without labelled rows of both classes every score is 0; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import Words, fold, hash_counts, in_place, load_arrays, save_arrays, scratch, slices, slimmed, spans, stored, table, text_of

SAMPLE, K, THRESHOLD, BLOCK, DENSE = 12_000, 16, 0.7, 128, 384
OPENINGS = (6,)
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _term_lists(words: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(0, the bare words), then (size, openings of that size); '' where a word has no such term."""
    bare = pc.utf8_trim(pc.utf8_lower(words), STRIP)
    yield 0, bare
    for size in OPENINGS:
        yield size, pc.if_else(pc.greater(pc.utf8_length(bare), size), pc.utf8_slice_codeunits(bare, 0, size), "")


def term_counts(texts: pa.Array, vocabulary: dict[int, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term number, count), sorted; vocabulary: words under 0, openings under their length. Term
    numbers run through the vocabulary's arrays in turn."""
    w = Words(texts)
    found, base, rows = [], 0, w.rows()
    for size, of in _term_lists(w.words):
        terms = vocabulary[size]
        code = np.asarray(pc.fill_null(pc.index_in(of, value_set=terms), -1), np.int64)[w.ids]
        hit = np.flatnonzero(code >= 0)
        found.append(rows[hit] << 32 | (code[hit] + base))
        base += len(terms)
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


class Index:
    """Unit vectors of examples, in blocks: postings of rare terms, a matrix of the commonest, and block maxima."""

    ARRAYS = ["slot", "example", "matrix", "tops", "at", "value", "start"]

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], block: int = BLOCK) -> Index:
        """The index that has these arrays."""
        own = cls.__new__(cls)
        own.__dict__.update(arrays)
        own.n, own.block, own.blocks = len(own.example), block, len(own.tops)
        return own

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int = BLOCK, dense: int = DENSE):
        df = np.bincount(terms, minlength=n_terms)
        common = np.argsort(-df, kind="stable")[: min(dense, n_terms)]
        self.slot = np.full(n_terms, -1, np.int32)
        self.slot[common] = np.arange(len(common))
        # examples that share their commonest term lie together, so that a block's maxima say more
        lead = np.full(n, len(common), np.int64)
        own = self.slot[terms]
        np.minimum.at(lead, rows[own >= 0], own[own >= 0])
        self.example = np.argsort(lead, kind="stable")
        place = np.empty(n, np.int32)
        place[self.example] = np.arange(n)
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        self.matrix = np.zeros((self.blocks * block, len(common)))
        some = np.flatnonzero(own >= 0)
        self.matrix[place[rows[some]], own[some]] = weights[some]
        self.tops = self.matrix.reshape(self.blocks, block, -1).max(axis=1)
        few = np.flatnonzero(own < 0).astype(np.int32)
        few = few[np.argsort(terms[few], kind="stable")]
        self.at, self.value = place[rows[few]], weights[few]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(terms[few], minlength=n_terms))])

    def nearest(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples), n x k, best first, of the examples with the largest positive cosine; cosine 0: none."""
        size, own = self.blocks * self.block, self.slot[terms]
        few = np.flatnonzero(own < 0)
        first = self.start[terms[few]]
        times, cut = self.start[terms[few] + 1] - first, np.searchsorted(rows[few], np.arange(n + 1))
        score = np.zeros((n, size))
        for i in np.flatnonzero(np.diff(cut)).tolist():  # one text at a time: what it touches stays in the cache
            t = slice(cut[i], cut[i + 1])
            at = spans(first[t], times[t])
            score[i] = np.bincount(self.at[at], np.repeat(weights[few[t]], times[t]) * self.value[at], size)
        score = score.reshape(n, self.blocks, self.block)
        query = np.zeros((n, self.matrix.shape[1]))
        query[rows[own >= 0], own[own >= 0]] = weights[own >= 0]
        bound = score.max(axis=2) + query @ self.tops.T
        done = np.zeros((n, self.blocks), bool)
        if without is not None:
            place = np.empty(self.n, np.int64)
            place[self.example] = np.arange(self.n)
            place = place[without]

        def visit(want: np.ndarray) -> None:
            for b in np.flatnonzero(want.any(axis=0)).tolist():
                r = np.flatnonzero(want[:, b])
                score[r, b] += query[r] @ self.matrix[b * self.block : (b + 1) * self.block].T
                if without is not None:
                    mine = np.flatnonzero(place[r] // self.block == b)
                    score[r[mine], b, place[r[mine]] % self.block] = 0
            done[want] = True

        def kth(x: np.ndarray) -> np.ndarray:
            return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.zeros(n)

        best = np.argsort(-bound, axis=1)[:, :2]
        want = np.zeros((n, self.blocks), bool)
        want[np.arange(n)[:, None], best] = True
        visit(want)
        least = kth(np.take_along_axis(score, best[:, :, None], axis=1).reshape(n, -1))
        visit((bound >= least[:, None] - 1e-9) & (bound > 0) & ~done)
        score = np.where(done[:, :, None], score, 0).reshape(n, size)
        k = min(k, size)
        least = np.partition(score, size - k, axis=1)[:, size - k]
        r, p = np.nonzero((score > 0) & (score >= least[:, None] - 1e-9))
        x, e = np.round(score[r, p], 9), self.example[np.minimum(p, self.n - 1)]
        order = np.lexsort((e, -x, r))
        r, x, e = r[order], x[order], e[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        cosines, examples = np.zeros((n, k)), np.zeros((n, k), np.int64)
        use = rank < k
        cosines[r[use], rank[use]], examples[r[use], rank[use]] = x[use], e[use]
        return cosines, examples


def monotone(raw: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (raw votes, probabilities) at both ends of each pool, with one added count a class."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # lowest raw vote, highest, toxic, all
    for x, y in zip(raw[order].tolist(), toxic[order].tolist()):
        if pools and pools[-1][1] == x:
            pools[-1][2] += y
            pools[-1][3] += 1
        else:
            pools.append([x, x, y, 1])
    merged: list[list[float]] = []
    for p in pools:
        merged.append(p)
        while len(merged) > 1 and merged[-2][2] * merged[-1][3] >= merged[-1][2] * merged[-2][3]:
            _, high, y, n = merged.pop()
            merged[-1][1] = high
            merged[-1][2] += y
            merged[-1][3] += n
    return np.asarray([e for m in merged for e in m[:2]]), np.asarray([(m[2] + 1) / (m[3] + 2) for m in merged for _ in range(2)])


def unit(weight: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Weights of the terms of n texts, scaled to length 1."""
    x = np.log(counts, dtype=np.float64)
    x += 1
    x *= weight[terms]
    x /= np.sqrt(np.bincount(rows, x * x, n))[rows]
    return x


def built(n: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Index:
    """The index of examples with n terms each."""
    rows, ends = np.repeat(np.arange(len(n), dtype=np.int32), n), np.concatenate([[0], np.cumsum(n)])
    weights = np.empty(len(rows))
    for a in range(0, len(n), 1000):  # so that little is held besides
        b = min(a + 1000, len(n))
        own = slice(ends[a], ends[b])
        weights[own] = unit(weight, rows[own] - a, terms[own], counts[own], b - a)
    return Index(rows, terms, weights, len(n), len(weight))


class Model:
    """Everything that scoring needs; bounded by the sample. The index is built once, in a task, and lies in the shared
    folder, from which workers map it."""

    def __init__(self, vocabulary: dict[int, pa.Array], weight: np.ndarray, ids: np.ndarray, toxic: np.ndarray, k: int, folder: str = ""):
        """folder: of the index's arrays."""
        self.vocabulary, self.weight, self.ids, self.toxic, self.k, self.folder = vocabulary, weight, ids, toxic, k, folder
        self.base = float(toxic.mean()) if len(toxic) else 0.0
        self._index: Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index.of(load_arrays(self.folder, Index.ARRAYS))
        return self._index

    def unit(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        return unit(self.weight, rows, terms, counts, n)

    def votes(self, texts: pa.Array, without: np.ndarray | None = None, batch: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(votes, cosines, examples) of some texts, by batches."""
        whole = term_counts(texts, self.vocabulary)
        for a in range(0, len(texts), batch):
            n = min(batch, len(texts) - a)
            own = slice(*np.searchsorted(whole[0], [a, a + n]))
            yield self._votes(whole[0][own] - a, whole[1][own], whole[2][own], n, None if without is None else without[a : a + n])

    def _votes(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cosines, examples = self.index.nearest(rows, terms, self.unit(rows, terms, counts, n), n, self.k, without)
        w = np.where(cosines > 0, 1 / (1.1 - np.minimum(1.0, cosines)), 0.0)
        raw = ((w * self.toxic[examples]).sum(axis=1) + self.base) / (w.sum(axis=1) + 1)
        return np.where(cosines[:, 0] > 0, raw, 0.0), cosines, examples

    def score(self, texts: pa.Array, calibration: tuple[np.ndarray, np.ndarray], evidence: int = 3) -> tuple[np.ndarray, list[list[dict]]]:
        if not len(self.ids):
            return np.zeros(len(texts)), [[] for _ in range(len(texts))]
        scores, why = [], []
        for raw, cosines, examples in self.votes(texts):
            scores.append(np.interp(raw, *calibration))
            for x, e in zip(cosines[:, :evidence].tolist(), examples[:, :evidence].tolist()):
                why.append([{"doc_id": int(self.ids[i]), "cosine": c, "toxic": int(self.toxic[i])} for c, i in zip(x, e) if c > 0])
        return np.concatenate([np.zeros(0), *scores]), why


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = K, relevance: bool = True) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray]]:
    """(the model, broadcast; its calibration). docs: (doc_id, text); labels: (doc_id, toxic), only rows to learn from."""
    spark = docs.sparkSession
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = picked.withColumn("h", F.xxhash64("doc_id")).sort("h", "doc_id").limit(sample).select("doc_id", "toxic").collect()  # at most `sample`
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")
    texts = stored(docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text"):
                w, toxic = Words(p.column(2)), np.asarray(p.column(1)).astype(np.int64)
                rows = w.rows()
                for size, of in _term_lists(w.words):
                    coded = of.dictionary_encode()
                    key = np.unique(rows << 32 | np.asarray(coded.indices)[w.ids])
                    a = np.bincount(key & 0xFFFFFFFF, toxic[key >> 32], len(coded.dictionary)).astype(np.int64)
                    n = np.bincount(key & 0xFFFFFFFF, minlength=len(coded.dictionary))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int32)), coded.dictionary.cast(pa.string()), pa.array(a), pa.array(n - a)], ["size", "term", "a", "b"])

    counts = texts.mapInArrow(slimmed(count), "size int, term string, a long, b long").where("term <> ''").groupBy("size", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    terms = counts.sort("size", "term").toArrow()  # all terms of the sample
    sizes = np.asarray(terms["size"])
    vocabulary = {s: terms["term"].combine_chunks().cast(pa.large_string()).filter(pa.array(sizes == s)) for s in (0, *OPENINGS)}
    n_terms, shift = len(sizes), np.uint64(64 - max(1, len(sizes)).bit_length())
    if not n_terms or not {0, 1} <= {r.toxic for r in picked}:
        none = np.zeros(0, np.int64)
        return spark.sparkContext.broadcast(Model(vocabulary, np.zeros(0), none, none, k)), (np.zeros(1), np.zeros(1))

    def frequencies(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in slices(b, "text", 8 << 20):
            n = np.bincount(term_counts(p.column(0), vocabulary)[1], minlength=n_terms)
            t = np.flatnonzero(n)
            yield t.astype(np.uint64) << shift, n[t]

    of = hash_counts(docs.select("text"), frequencies, int(spark.conf.get("spark.sql.shuffle.partitions"))).toArrow()  # at most the terms of the sample
    df = np.zeros(n_terms, np.int64)
    df[(np.asarray(of["h"]).view(np.uint64) >> shift).astype(np.int64)] = np.asarray(of["n"])
    weight = np.log((1 + docs.count()) / (1 + df)) + 0.1
    if relevance:
        weight *= np.log2(2 + np.asarray(terms["a"]) / np.maximum(1, np.asarray(terms["b"])))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text"):
                rows, t, c = term_counts(p.column(2), vocabulary)
                cut = pa.array(np.searchsorted(rows, np.arange(p.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), *(pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (t, c))], ["doc_id", "toxic", "terms", "counts"])

    folder = scratch(spark, "toxicity-index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0), b.column(1), np.asarray(pc.list_value_length(b.column(2)), np.int64), np.asarray(b.column(2).flatten()), np.asarray(b.column(3).flatten())) for b in batches if b.num_rows]
        if not held:
            return
        ids, toxic, n, t, c = zip(*held)
        index = built(*(np.concatenate(x) for x in (n, t, c)), weight)
        own = f"{folder}/{uuid.uuid4().hex}"  # of this attempt
        save_arrays(own, {x: getattr(index, x) for x in Index.ARRAYS})
        for a, b in zip(ids, toxic):
            yield pa.RecordBatch.from_arrays([a, b, pa.array([own] * len(a))], ["doc_id", "toxic", "folder"])

    examples = texts.mapInArrow(slimmed(vectors), "doc_id long, toxic int, terms array<int>, counts array<int>").repartition(1).sortWithinPartitions("doc_id")  # at most `sample`
    examples = examples.mapInArrow(slimmed(build), "doc_id long, toxic int, folder string").toArrow()
    model = Model(vocabulary, weight, np.asarray(examples["doc_id"]), np.asarray(examples["toxic"]).astype(np.int64), k, examples["folder"][0].as_py())
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text", 2 << 20):
                own = np.searchsorted(shared.value.ids, np.asarray(p.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([v for v, _, _ in shared.value.votes(p.column(1), own)]))], ["e", "raw"])

    raw = texts.select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(slimmed(left_out), "e long, raw double").toArrow()  # at most `sample`
    return shared, monotone(np.asarray(raw["raw"]), model.toxic[np.asarray(raw["e"])])


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, score, evidence) for docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shared, calibration = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), **how)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text", 2 << 20):
                got, why = shared.value.score(p.column(1), calibration)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(got), pa.array(why, kind)], ["doc_id", "score", "evidence"])

    return docs.mapInArrow(slimmed(run), "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The documents that score below the threshold, all columns; rows are dropped in place."""
    shared, calibration = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), **how)
    at = docs.columns.index("text")
    name = f"c{at}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, name, 2 << 20):
                yield p.filter(pa.array(shared.value.score(p.column(at), calibration, 0)[0] < threshold))

    return in_place(docs, run)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the id's text mod 3 is not 1."""
    return labels.where(fold("doc_id", 3) != 1)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = score(table(spark, sf_dir, "documents"), training_labels(table(spark, sf_dir, "labels")))
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
