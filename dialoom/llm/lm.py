"""Language-model scores from a log-frequency Bloom filter.

Tokens are a text's words (A-Z lower-cased) and one end mark. The base is the add-one unigram score, exact. The model
is a bigram with Dirichlet smoothing,

    P(w | h) = (c(hw) + mu P(w)) / (c(h) + mu),

P(w) the add-one unigram probability. The counts c(hw) and c(h) come from a Bloom filter that holds each n-gram once for
every power of two that its count reaches; probes for one level after the other tell the count to a factor of two.

Scale: the filter has `bits` bits a training token, so it grows with the corpus, and isn't broadcast whole: it lies in
blocks, and each block's task builds it and answers all probes to it. An n-gram belongs to the block of its last word,
where that word's own count is at hand; the logarithm of the denominator belongs to h, and is added in the block of h.
So one pass over the texts deals every token to one block, whatever the number of blocks, and sums come back by text.
Words of relative frequency 1/`frequent` or more (at most `frequent` words) are broadcast with their counts and those of
their pairs: an n-gram of two such words is answered in place, from counts that are cut to powers of two as the filter's
are, one that ends in such a word is dealt by its pair. So no block gets more than 1/`frequent` of all tokens for one
word or pair.

Defined results: null and empty texts have one token, the end; repeated rows score alike; a null id is hashed as
''; without training rows every count is 0; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import Words, buckets_for, dealt, fold, hash_counts, merged, mix, slices, stored, table, text_of, word_hashes

FREQUENT, BITS, BLOCK_TOKENS, TASK_TOKENS, PROBES, MU = 2000, 6, 600_000, 2_500_000, 5, 300.0
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
PAIR, LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Tokens:
    """Hashes of the tokens of some texts, each with the token before it; text i has start[i]:start[i+1]."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        words = word_hashes(w.words)
        self.hash = np.insert(words[w.ids], w.start[1:], END)
        self.start = w.start + np.arange(len(w.start))
        self.lengths = np.diff(self.start)
        self.before = np.concatenate([[START], self.hash[:-1]]).astype(np.uint64)
        self.before[self.start[:-1]] = START


def cut_counts(n: np.ndarray) -> np.ndarray:
    """Counts as the filter knows them: 0, 1, or 1.2 times the largest power of two that they reach."""
    level = np.floor(np.log2(np.maximum(n, 1))) + (n > 0)
    return np.where(level > 1, 1.2 * 2.0 ** (level - 1), level)


class Frequent:
    """Exact counts of the frequent words and of their pairs, and what scoring needs besides."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int, texts: int):
        """The start mark counts as a frequent word that occurs once a text."""
        order = np.argsort(np.append(hashes, START))
        self.hashes, self.counts = np.append(hashes, START)[order], np.append(counts, texts)[order]
        self.tokens, self.types, self.total = tokens, types, tokens + types + 1
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of frequent words, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def pair_counts(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        key = first * len(self.hashes) + last
        if not len(self.pairs):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.times[at], 0)


class Filter:
    """A block: distinct keys at each power of two that their counts reach, in `bits` bits a unit of their counts or more."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        self.field = np.zeros(1 << max(6, (bits * int(counts.sum())).bit_length()), bool)
        level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
        for x in range(int(level.max()) + 1 if len(keys) else 0):
            spot, step = self._spots(keys[level >= x], x)
            for _ in range(PROBES):
                self.field[self._bit(spot)] = True
                spot += step

    def _spots(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            x = mix(keys + np.uint64(level) * LEVEL)
        return x, x >> np.uint64(32) | np.uint64(1)

    def _bit(self, spot: np.ndarray) -> np.ndarray:
        return (spot & np.uint64(len(self.field) - 1)).astype(np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts to a factor of two: probes level after level until one fails."""
        level, live, x = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(live):
            spot, step = self._spots(keys[live], x)
            for _ in range(PROBES):
                here = self.field[self._bit(spot)]
                live, spot, step = live[here], spot[here], step[here]
                spot += step
            level[live] += 1
            x += 1
        return np.where(level > 1, 1.2 * 2.0 ** (level - 1), level)


def frequent_words(learn: DataFrame, frequent: int) -> Frequent:
    """From all rows of learn (text)."""
    spark = learn.sparkSession

    def words(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in slices(b, "text", 2 << 20):
            w = Words(p.column(0))
            yield np.append(word_hashes(w.words), END), np.append(np.bincount(w.ids, minlength=len(w.words)), p.num_rows)

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), learn.rdd.getNumPartitions())
    counts = stored(hash_counts(learn.select("text"), words, buckets), "words")
    tokens, types, texts = counts.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == int(END.view(np.int64)), F.col("n"))), F.lit(0))).first()
    often = counts.where(F.col("n") * frequent >= tokens).toArrow()  # at most `frequent` rows
    found = Frequent(np.asarray(often["h"]).view(np.uint64), np.asarray(often["n"]), tokens, types, texts)
    shared, m = spark.sparkContext.broadcast(found), len(found.hashes)
    shift = np.uint64(64 - max(1, m * m).bit_length())

    def pairs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in slices(b, "text", 2 << 20):
            t = Tokens(p.column(0))
            first, last = shared.value.place(t.before), shared.value.place(t.hash)
            both = (first >= 0) & (last >= 0)
            key, n = np.unique(first[both] * m + last[both], return_counts=True)
            yield key.astype(np.uint64) << shift, n

    of = hash_counts(learn.select("text"), pairs, int(spark.conf.get("spark.sql.shuffle.partitions"))).toArrow()  # at most m * m rows
    key = (np.asarray(of["h"]).view(np.uint64) >> shift).astype(np.int64)
    order = np.argsort(key)
    found.pairs, found.times = key[order], np.asarray(of["n"])[order]
    return found


SUMS = ["slice", "who", "part", "logs", "known", "tokens", "doc_id"]


def _lists(n: int, **columns) -> list[pa.Array]:
    """Each column as one list of n elements, in one row; None: an empty list of nothing."""
    cut = pa.array(np.asarray([0, n], np.int32))
    return [pa.ListArray.from_arrays(cut, x if isinstance(x, pa.Array) else pa.array(x)) for x in columns.values()]


def score(docs: DataFrame, train: Column, mu: float = MU, bits: int = BITS, block_tokens: int = BLOCK_TOKENS, frequent: int | None = None) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for docs (doc_id, text); `train` picks the rows to learn from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    top = frequent_words(docs.where("train"), frequent or FREQUENT)
    shared, total = spark.sparkContext.broadcast(top), top.total
    blocks = buckets_for(spark, top.tokens, block_tokens)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Array rows of tokens for each block, and one row with the sums that each slice of texts knows itself."""
        f, number = shared.value, TaskContext.get().partitionId() << 32
        logs_of, under = np.log10(f.counts + 1.0), np.log10(cut_counts(f.counts) + mu)
        for b in batches:
            for p in slices(b, "text", 2 << 20):
                t, n = Tokens(p.column(1)), p.num_rows
                who = 2 * np.arange(n) + np.asarray(p.column(2).cast(pa.int8()))
                row = np.repeat(np.arange(n), t.lengths)
                first, last = f.place(t.before), f.place(t.hash)
                known, both = last >= 0, (first >= 0) & (last >= 0)
                part = np.zeros(len(row))
                part[both] = np.log10(cut_counts(f.pair_counts(first[both], last[both])) + mu * (f.counts[last[both]] + 1) / total)
                part[first >= 0] -= under[first[first >= 0]]
                logs = np.where(known, logs_of[last], 0.0)
                sums = lambda x: np.bincount(row, x, n)
                yield pa.RecordBatch.from_arrays([pa.array([blocks + number % blocks], pa.int32()), *_lists(0, w=pa.array([], pa.int64()), h=pa.array([], pa.int32())), *_lists(n, who=who.astype(np.int32)), pa.array([[number]], pa.list_(pa.int64())), pa.array([[n]], pa.list_(pa.int32())), *_lists(n, part=sums(part), logs=sums(logs), known=sums(known).astype(np.int32), tokens=t.lengths.astype(np.int32), doc_id=p.column(0))], DEALT)
                out = np.flatnonzero(~both)
                h32 = (t.before[out] >> np.uint64(32)).astype(np.uint32)
                w = t.hash[out]
                # the block of the last word, or of the pair where that word is frequent
                by = np.where(last[out] < 0, w, mix(w + h32 * PAIR))
                rows = dealt({"bucket": ((mix(by) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32), "w": w.view(np.int64), "h": h32.view(np.int32), "who": who[row[out]].astype(np.int32)})
                if rows.num_rows:
                    lengths = pc.list_value_length(rows.column(1)).cast(pa.int32())
                    one = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32))
                    none = lambda kind: pa.ListArray.from_arrays(pa.array(np.zeros(rows.num_rows + 1, np.int32)), pa.array([], kind))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(one, pa.array(np.full(rows.num_rows, number))), pa.ListArray.from_arrays(one, lengths), none(pa.float64()), none(pa.float64()), none(pa.int32()), none(pa.int32()), none(pa.int64())], DEALT)
                number += 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block after block; a text's sums go on once for several blocks."""
        held: list[pa.RecordBatch] = []
        sums: list[tuple[np.ndarray, ...]] = []

        def block() -> Iterator[pa.RecordBatch]:
            sums.append(answered(held))
            held.clear()
            if sum(len(x[0]) for x in sums) > TASK_TOKENS:
                yield together()

        def together() -> pa.RecordBatch:
            number, who, *rest = (np.concatenate(x) for x in zip(*sums))
            sums.clear()
            order = np.lexsort((who, number))
            number, who = number[order], who[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(number) != 0) | (np.diff(who) != 0)]))
            part, logs, known = (np.add.reduceat(x[order], first) for x in rest)
            edge = np.flatnonzero(np.concatenate([[True], np.diff(number[first]) != 0]))
            lists = pa.array(np.append(edge, len(first)).astype(np.int32))
            none = lambda kind: pa.ListArray.from_arrays(pa.array(np.zeros(len(edge) + 1, np.int32)), pa.array([], kind))
            columns = [who[first].astype(np.int32), part, logs, known.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(number[first[edge]]), *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in columns), none(pa.int32()), none(pa.int64())], SUMS)

        for b in batches:
            bucket = np.asarray(b.column(0))
            own = pa.array(bucket >= blocks)
            passed = b.filter(own)  # the slices' own sums
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column(DEALT.index("slice")).flatten(), *(passed.column(DEALT.index(c)) for c in SUMS[1:])], SUMS)
            b, bucket = b.filter(pc.invert(own)), bucket[bucket < blocks]
            edge = np.flatnonzero(np.diff(bucket)) + 1
            for a, z in zip(np.append(0, edge).tolist(), np.append(edge, len(bucket)).tolist()):
                if z > a:
                    if held and held[-1].column(0)[0].as_py() != bucket[a]:
                        yield from block()
                    held.append(b.slice(a, z - a))
        if held:
            yield from block()
        if sums:
            yield together()

    def answered(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        """(slice, who, part, logs, known) of one block's tokens by text: counts of the training tokens, the filter of
        them, and all probes."""
        f = shared.value
        whole = pa.Table.from_batches(held).combine_chunks()
        w, h, who, number, n = (np.asarray(whole[c].combine_chunks().flatten()) for c in ("w", "h", "who", "slice", "n"))
        w = w.view(np.uint64)
        learn = who & 1 == 1
        words, of = np.unique(w, return_inverse=True)
        place = f.place(words)
        exact = np.where(place >= 0, f.counts[place], np.bincount(of, learn, len(words)).astype(np.int64))
        with np.errstate(over="ignore"):
            pair = mix(w + h.view(np.uint32) * PAIR)
        keys, times = merged([(pair[learn], np.ones(int(learn.sum()), np.int64))])
        rare = (place < 0) & (exact > 0)
        block = Filter(np.concatenate([keys, mix(words[rare] ^ LEVEL)]), np.concatenate([times, exact[rare]]), bits)
        context = np.where((place < 0) & (words != END), np.log10(block.counts(mix(words ^ LEVEL)) + mu), 0.0)
        alone = place < 0
        part = np.log10(block.counts(pair) + (mu * (exact + 1) / total)[of]) - context[of]
        # a context that is not frequent is taken off in the block of its own word; the tokens dealt here come by text
        row = np.repeat(np.arange(len(n)), n)
        key = row << 32 | who >> 1
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        add = lambda x: np.add.reduceat(x, first)
        return number[row[first]], who[first], add(part), add(np.where(alone, np.log10(exact + 1.0), 0.0)[of]), add(((exact > 0) & alone)[of].astype(np.int64))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each slice's texts; its array rows come together."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            number = np.asarray(b.column(0))
            edge = np.flatnonzero(np.diff(number)) + 1
            for a, z in zip(np.append(0, edge).tolist(), np.append(edge, len(number)).tolist()):
                if z > a:
                    if held and held[-1].column(0)[0].as_py() != number[a]:
                        yield added(held)
                        held = []
                    held.append(b.slice(a, z - a))
        if held:
            yield added(held)

    def added(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        own = np.flatnonzero(np.asarray(pc.list_value_length(whole["tokens"].combine_chunks())) > 0)
        mine = whole.slice(int(own[0]), 1)
        who = np.asarray(whole["who"].combine_chunks().flatten()) >> 1
        tokens = mine["tokens"].combine_chunks().flatten()
        n = len(tokens)
        sums = [np.bincount(who, np.asarray(whole[c].combine_chunks().flatten()), n) for c in ("part", "logs", "known")]
        learn = np.asarray(mine["who"].combine_chunks().flatten()) & 1 == 1
        return pa.RecordBatch.from_arrays([mine["doc_id"].combine_chunks().flatten(), pa.array(learn), tokens.cast(pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])], ["doc_id", "train", "n_tokens", "n_known", "logs", "score"])

    lists = "who array<int>, {}part array<double>, logs array<double>, known array<int>, tokens array<int>, doc_id array<long>"
    tokens = docs.select("doc_id", "text", "train").mapInArrow(deal, "bucket int, w array<long>, h array<int>, " + lists.format("slice array<long>, n array<int>, "))
    tasks = buckets_for(spark, top.tokens, TASK_TOKENS)
    sums = tokens.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, "slice long, " + lists.format(""))
    rows = sums.repartition("slice").sortWithinPartitions("slice").mapInArrow(collect, "doc_id long, train boolean, n_tokens long, n_known long, logs double, score double")
    return rows.select("doc_id", "train", "n_tokens", "n_known", F.lit(top.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * math.log10(total)).alias("base_score"), "score")


DEALT = ["bucket", "w", "h", "who", "slice", "n", "part", "logs", "known", "tokens", "doc_id"]


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents whose fold of 7 isn't 2; score all."""
    got = score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
