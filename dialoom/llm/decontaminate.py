"""Benchmark decontamination by greedy string tiling.

An item leaks into a document where tiles (equal runs of at least `min_match` words, longest first, no word of
either side in two tiles) cover at least `coverage` of the item's words; the order of the tiles doesn't matter,
so passages that were cut up and reordered are found. Seeds are equal runs of `min_match` words, found by a
rolling (Karp-Rabin) hash and checked word by word.

Search: an item's runs are ordered by rarity among the items; those that are left when the most frequent ones, as
many as cover less than `coverage` of the item, are set aside must share a run with any document that it leaks
into. Only these are in the index that finds the pairs of document and item; a pair's seeds are joined by run, one
pair at a time, and of pairs whose seeds cover enough the maximal matches go to the tiling.

Scale: documents never move. The items are a stated query set: they are cut into blocks of at most
`block_bytes` of text and each block is broadcast in turn over all documents.

Defined results: null or empty texts and items match nothing; an item of fewer than `min_match` words can't be
tested and is never reported; repeated rows are each reported; empty tables give no rows; only the named
columns are read. Words are whitespace-separated, A-Z lower-cased.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import Words, in_place, mix, rolled, slices, slimmed, spans, table, text_of

MIN_MATCH, COVERAGE, BLOCK_BYTES = 4, 0.5, 16 << 20
#: A pair with more seeds is compared along its diagonals, so many cells at a time.
SEEDS, CELLS = 1 << 20, 1 << 20


def maximal(p: np.ndarray, q: np.ndarray, min_match: int) -> Iterator[tuple[int, int, int]]:
    """(doc start, item start, length) of the longest runs along each diagonal, from seeds (p, q)."""
    order = np.lexsort((p, q - p))
    p, q = p[order], q[order]
    new = np.concatenate([[True], (np.diff(q - p) != 0) | (np.diff(p) != 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(p))) + min_match - 1
    yield from zip(p[first].tolist(), q[first].tolist(), n.tolist())


def along_diagonals(doc: np.ndarray, item: np.ndarray, min_match: int) -> Iterator[tuple[int, int, int]]:
    """As `maximal`, from the words themselves: for texts that repeat one run so often that their seeds, which are as many
    as the product of both numbers, would not fit in memory."""
    m = len(item)
    padded = np.concatenate([np.full(m, -1), doc, np.full(m, -1)])  # unknown words are -1, too
    view = np.lib.stride_tricks.sliding_window_view(padded, m)  # row s: the words that stand at the item's on diagonal s - m
    each = max(1, CELLS // (m + 2))
    for a in range(0, len(view), each):
        same = np.zeros((min(each, len(view) - a), m + 2), np.int8)
        same[:, 1:-1] = view[a : a + each] == item
        turn = np.diff(same, axis=1)
        row, first = np.nonzero(turn == 1)
        _, end = np.nonzero(turn == -1)
        long = end - first >= min_match
        yield from zip((row[long] + first[long] + a - m).tolist(), first[long].tolist(), (end - first)[long].tolist())


def tile(item_words: int, matches: Iterator[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from maximal matches (doc start, item start, length): tiles of the same form.

    The longest match of unmarked words goes first (ties: earliest in the item, then in the document); a match
    that earlier tiles cut into is put back in the parts that are left."""
    heap = [(-n, q, p) for p, q, n in matches]
    heapq.heapify(heap)
    used_item, used_doc, tiles, left = bytearray(item_words), set(), [], item_words
    while heap and left >= min_match:
        n, q, p = heapq.heappop(heap)
        n = -n
        free = [not used_item[q + k] and p + k not in used_doc for k in range(n)]
        if all(free):
            tiles.append((p, q, n))
            left -= n
            used_item[q : q + n] = b"\1" * n
            used_doc.update(range(p, p + n))
            continue
        k = 0
        while k < n:
            e = k
            while e < n and free[e]:
                e += 1
            if e - k >= min_match:
                heapq.heappush(heap, (-(e - k), q + k, p + k))
            k = max(e, k + 1)
    return sorted(tiles, key=lambda t: t[1])


def telling(runs: np.ndarray, times: np.ndarray, words: int, min_match: int, coverage: float) -> np.ndarray:
    """Places of an item's runs, the rarest, without one of which nothing can cover enough of the item's words."""
    covered, marks, order = 0, bytearray(words), np.lexsort((runs, -times)).tolist()
    for k, q in enumerate(order):
        covered += min_match - sum(marks[q : q + min_match])
        if covered >= coverage * words:
            return np.asarray(order[k:], np.int64)
        marks[q : q + min_match] = b"\1" * min_match
    return np.zeros(0, np.int64)


class Items:
    """One block of benchmark items, ready to be broadcast."""

    def __init__(self, ids: list, texts: list[str | None], min_match: int, coverage: float):
        w = Words(pa.array(texts, pa.large_string()))
        self.ids, self.words, self.start, self.codes, self.min_match, self.coverage = ids, w.words, w.start, w.ids, min_match, coverage
        runs = rolled(mix(self.codes.astype(np.uint64) + np.uint64(1)), min_match)
        _, of, times = np.unique(runs, return_inverse=True, return_counts=True)
        self.own, index = [], []  # each item's runs by hash: (hashes, places)
        for i, (a, b) in enumerate(zip(w.start.tolist(), w.start[1:].tolist())):
            own = runs[a : max(a, b - min_match + 1)]
            order = np.argsort(own, kind="stable")
            self.own.append((own[order], order))
            q = telling(own, times[of[a : a + len(own)]], b - a, min_match, coverage)
            index.append((np.unique(own[q]), i))
        runs = np.concatenate([np.zeros(0, np.uint64), *(r for r, _ in index)])
        item = np.repeat(np.asarray([i for _, i in index], np.int64), [len(r) for r, _ in index])
        order = np.argsort(runs, kind="stable")
        self.runs, self.item_of = runs[order], item[order]

    def search(self, texts: pa.Array) -> list[tuple[int, int, list]]:
        """(text number, item number, tiles) wherever tiles cover enough of the item."""
        k, w = self.min_match, Words(texts)
        if not len(w.ids) or not len(self.runs):
            return []
        known = np.asarray(pc.fill_null(pc.index_in(w.words, value_set=self.words), -1), dtype=np.int64)[w.ids]
        good = np.concatenate([[0], np.cumsum(known >= 0)])
        spots = np.flatnonzero(good[k:] - good[:-k] == k) if len(known) >= k else np.zeros(0, np.int64)
        doc_of = np.searchsorted(w.start, spots, side="right") - 1
        whole = spots + k <= w.start[doc_of + 1]
        spots, doc_of = spots[whole], doc_of[whole]
        if not len(spots):
            return []
        grams = known[spots[:, None] + np.arange(k)]
        with np.errstate(over="ignore"):
            h, coded = np.zeros(len(spots), np.uint64), mix(grams.astype(np.uint64) + np.uint64(1))
            for i in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + coded[:, i]
        h = mix(h)
        order = np.lexsort((h, doc_of))
        spots, doc_of, grams, h = spots[order], doc_of[order], grams[order], h[order]
        once = np.flatnonzero(np.concatenate([[True], (np.diff(h) != 0) | (np.diff(doc_of) != 0)]))  # a document's runs once
        low, high = np.searchsorted(self.runs, h[once], "left"), np.searchsorted(self.runs, h[once], "right")
        pairs = np.unique(np.repeat(doc_of[once], high - low) << 32 | self.item_of[spans(low, high - low)])
        edge, out = np.searchsorted(doc_of, np.arange(len(w.lengths) + 1)), []
        for d, i in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
            mine, (runs, places) = slice(edge[d], edge[d + 1]), self.own[i]
            low, high = np.searchsorted(runs, h[mine], "left"), np.searchsorted(runs, h[mine], "right")
            item = self.codes[self.start[i] : self.start[i + 1]]
            if int((high - low).sum()) > SEEDS:
                tiles = tile(len(item), along_diagonals(known[w.start[d] : w.start[d + 1]], item, k), k)
                if sum(t[2] for t in tiles) >= self.coverage * len(item):
                    out.append((d, i, tiles))
                continue
            at = np.repeat(np.arange(edge[d], edge[d + 1]), high - low)
            q = places[spans(low, high - low)]
            equal = (item[q[:, None] + np.arange(k)] == grams[at]).all(axis=1)
            p, q = spots[at[equal]] - w.start[d], q[equal]
            if not len(q) or len(np.unique(np.unique(q)[:, None] + np.arange(k))) < self.coverage * len(item):
                continue  # even overlapping seeds cover too little
            tiles = tile(len(item), maximal(p, q, k), k)
            if sum(t[2] for t in tiles) >= self.coverage * len(item):
                out.append((d, i, tiles))
        return out


def blocks(items: DataFrame, item_id: str, text: str, min_match: int, coverage: float, block_bytes: int) -> Iterator[Items]:
    """The items in blocks: each has about block_bytes of text at most (one item at least)."""
    picked = items.select(F.col(item_id).alias("item"), text_of(text).alias("text"))
    total, n = picked.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-int(total) // block_bytes))
    for part in range(parts):
        own = picked if parts == 1 else picked.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        rows = own.sort("item", "text").collect() if n else []
        yield Items([r.item for r in rows], [r.text for r in rows], min_match, coverage)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, matched, coverage, tiles): one row for each document and item that it leaks."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tiles_type = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
    schema = "doc_id long, item_id long, item_words int, matched int, coverage double, tiles array<struct<doc_start:int,item_start:int,words:int>>"
    spark, parts = docs.sparkSession, []
    for block in blocks(items, item_id, item_text, min_match, coverage, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                for part in slices(b, "text"):
                    ids = part.column(0)
                    hits = own.search(part.column(1))
                    n = [int(own.start[i + 1] - own.start[i]) for _, i, _ in hits]
                    m = [sum(t[2] for t in tiles) for _, _, tiles in hits]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([d for d, _, _ in hits], pa.int64())), pa.array([own.ids[i] for _, i, _ in hits], pa.int64()), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array([x / y for x, y in zip(m, n)], pa.float64()), pa.array([[dict(zip(("doc_start", "item_start", "words"), t)) for t in tiles] for _, _, tiles in hits], tiles_type)],
                        ["doc_id", "item_id", "item_words", "matched", "coverage", "tiles"],
                    )

        parts.append(picked.mapInArrow(slimmed(find), schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns; rows are dropped in place, without a join."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    name = f"c{at}"
    for block in blocks(items, item_id, item_text, min_match, coverage, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b, name):
                    good = np.ones(part.num_rows, bool)
                    good[[d for d, _, _ in shared.value.search(part.column(at))]] = False
                    yield part.filter(pa.array(good))

        docs = in_place(docs, keep)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each leaked item of each document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


