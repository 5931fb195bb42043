"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased, 64-bit hashes); lines of `min_words` words or more take part: all but
blank ones. Lines match at a Jaccard similarity of 4/5 or more. The earliest line (by document id, hash of the text,
line number) of each matching pair stays, later ones are removed: a line goes if any earlier line matches it.

Join: words are ordered by rarity, from counts over all lines (`Cells`; words that share a cell only share a rank).
Equal sets (128-bit keys) are one class. Of a class's n words the first n - ceil(4n/5) + 1 in that order are its
prefix; matching classes share a prefix word. Words that occur once can't be shared, and a class with too many of
them can't match. Under each prefix word, classes are candidates if lengths, positions and a 128-bit sketch of the
sets allow 4/5; a pair counts only under the first prefix word that it shares. That leaves (class, word) rows, not
pairs: the whole sets of those classes are fetched, dealt out by word once more, and all their pairs are verified in
place. Each class then has the number of lines that match it, its earliest match, and links that span its component.

Scale: rows between tasks are array columns, one row for each bucket of words. A word with over `large` classes is
cut in chunks, a group for each pair of chunks. All that is shipped grows with lines, never with matching pairs.

Defined results: null, empty and blank texts have no line that takes part; documents with a null id pass through; rows
that repeat an id and its text count as one document, texts that share an id each have their own lines; ties can't
occur between different lines; an empty table gives no rows; only the named columns are compared, and `deduplicated`
keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import Cells, HashedWords, buckets_for, by_bucket, dealt, flat, fresh, hash_counts, mix, slices, slimmed, spans, stored, table, text_of
from dialoom.llm.components import components, spanning

MIN_WORDS, LARGE = 1, 8192
#: So many of the prefix words before a word go with it: a pair that shares one of them counts there. Long prefixes have
#: more; classes that share only those are candidates once more, and the whole sets decide.
BEFORE = 4
SALT = np.uint64(0x9E3779B97F4A7C15)


def positions(doc: np.ndarray, t: np.ndarray, line: np.ndarray) -> np.ndarray:
    """64-bit hashes of lines' places."""
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(np.int64).view(np.uint64) * SALT + t.view(np.uint64)) + line.astype(np.uint64))


def twice(h: np.ndarray) -> np.ndarray:
    """Each hash and another one of it: a table of counts that has both is rarely wrong."""
    return np.concatenate([h, mix(h ^ SALT)])


def filed_in(cells: Cells, h: np.ndarray) -> np.ndarray:
    """Whether the table may hold these hashes, which were filed `twice`."""
    return (cells(h) > 0) & (cells(mix(h ^ SALT)) > 0)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, text number of each, line number in its text)."""
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, "\n")
    first = np.asarray(lists.offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return lists.flatten(), doc, np.arange(len(doc)) - first[doc]


class Lines:
    """Lines of `min_words` words or more as sets of words in order of rarity (in any where there is no table yet); line i is
    number at[i] of those given. distinct, times: the words of all lines and how often each occurs."""

    def __init__(self, lines: pa.Array, min_words: int, rarity: Cells | None = None):
        w = HashedWords(lines)
        self.at = np.flatnonzero(w.lengths >= max(1, min_words))
        self.distinct = hashes = w.hashes
        self.times = np.bincount(w.ids, minlength=len(hashes))
        if rarity is not None:  # the slice's distinct words in order
            code = rarity(hashes)
            order = np.lexsort((hashes, code))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes, self.codes = hashes[order], code[order]
        ids = w.ids if len(self.at) == len(w.lengths) else w.ids[np.repeat(w.lengths >= max(1, min_words), w.lengths)]
        both = np.repeat(np.arange(len(self.at)) << 32, w.lengths[self.at]) | (ids if rarity is None else rank[ids])
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        self.rows, self.ids = both >> 32, both & 0xFFFFFFFF
        self.words, self.mix = hashes, mix(hashes)
        self.n = np.bincount(self.rows, minlength=len(self.at))
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def _reduced(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values, self.start[:-1]) if len(self.at) else np.zeros(0, np.uint64)

    def keys(self) -> list[np.ndarray]:
        """128 bits that equal sets share."""
        with np.errstate(over="ignore"):
            return [mix(self._reduced(np.add, x[self.ids]) * np.uint64(31) + self.n.astype(np.uint64)).view(np.int64) for x in (self.mix, mix(self.mix + SALT))]

    def sketches(self) -> list[np.ndarray]:
        """Parities of the numbers of words in 128 places: two sketches differ in no more places than the sets in words."""
        bit, low = np.uint64(1) << (self.mix >> np.uint64(58)), self.mix >> np.uint64(57) & np.uint64(1) == 0
        return [self._reduced(np.bitwise_xor, np.where(x, bit, np.uint64(0))[self.ids]).view(np.int64) for x in (low, ~low)]


#: What a counted hash is of: its two low bits.
WORD, KEY, TEXT = 0, 1, 2


def _counted(min_words: int):
    """Hashes of words, of classes (`twice`) and of texts with their ids, to be counted in one pass over (doc_id, t, text)."""

    def kind(h: np.ndarray, of: int) -> np.ndarray:
        return h & ~np.uint64(3) | np.uint64(of)

    def values(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, t = np.asarray(b.column(0)), np.asarray(b.column(1))
        yield kind(positions(ids, t, np.zeros(len(ids), np.int64)), TEXT), np.ones(len(ids), np.int64)
        for p in slices(b, "text", 2 << 20):
            x = Lines(split(p.column(2))[0], min_words)
            k = kind(twice(_class_hash(x.keys()[0])), KEY)
            yield np.concatenate([kind(x.distinct, WORD), k]), np.concatenate([x.times, np.ones(len(k), np.int64)])

    return values


def _class_hash(k: np.ndarray) -> np.ndarray:
    return mix(k.view(np.uint64))


def prefixes(docs: DataFrame, rarity, keys, min_words: int) -> DataFrame:
    """(c, k, k2, again, doc_id, t, line_no, head, n, skip, prefix, s1, s2): each line's number, class, size, prefix words (top
    32 bits of their hash) from position `skip` on. again: whether another line may have the same key (by a table of
    counts, so never too seldom); the others are classes of their own, which need no shuffle. Within a task only the
    first line of a class has a prefix; head: the first line of a row."""

    def build(p: pa.RecordBatch, seen: set, number: int) -> pa.RecordBatch:
        lines, doc, line_no = split(p.column(2))
        x = Lines(lines, min_words, rarity.value)
        doc, line_no, (k, k2) = doc[x.at], line_no[x.at], x.keys()
        once = np.bincount(x.rows[(x.codes == 0)[x.ids]], minlength=len(x.n))
        least = (4 * x.n + 4) // 5
        upto = np.where(x.n - once < least, once, np.maximum(once, x.n - least + 1))
        if len(seen) > 500_000:
            seen.clear()
        again = filed_in(keys.value, _class_hash(k))
        old = np.zeros(len(k), bool)
        old[again] = np.fromiter((y in seen or seen.add(y) is not None for y in zip(k[again].tolist(), k2[again].tolist())), bool, int(again.sum()))
        upto = np.where(old | (x.n < 4), once, upto)  # sets of under four words match equal sets only
        own = x.words[x.ids[spans(x.start[:-1] + once, upto - once)]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(upto - once)]).astype(np.int32)), pa.array((own >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        take = pa.array(doc)
        columns = {"c": pa.array(number + np.arange(len(k))), "k": pa.array(k), "k2": pa.array(k2), "again": pa.array(again), "doc_id": p.column(0).take(take), "t": p.column(1).take(take), "line_no": pa.array(line_no.astype(np.int32)), "head": pa.array(head), "n": pa.array(x.n.astype(np.int32)), "skip": pa.array(once.astype(np.int32)), "prefix": lists}
        return pa.RecordBatch.from_arrays([*columns.values(), *map(pa.array, x.sketches())], [*columns, "s1", "s2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for p in slices(b, "text", 2 << 20):
                out = build(p, seen, number)
                number += out.num_rows
                yield out

    return docs.mapInArrow(slimmed(run), "c long, k long, k2 long, again boolean, doc_id long, t long, line_no int, head boolean, n int, skip int, prefix array<int>, s1 long, s2 long")


def _hashed(w: np.ndarray) -> np.ndarray:
    """64-bit hashes with these (signed) top 32 bits."""
    return w.astype(np.int64).view(np.uint64) << np.uint64(32)


def hot_words(classes: DataFrame, rarity, large: int) -> Cells | None:
    """Numbers of classes under prefix words that have over `large`. Only words that are frequent enough are counted."""

    def values(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = _hashed(flat(b.column(0))[1])
        h = h[Cells.at_most(rarity.value(h)) > large]
        yield h, np.ones(len(h), np.int64)

    found = stored(hash_counts(classes.select("prefix"), values, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), large + 1), "hot")
    return None if found.isEmpty() else Cells(found)


def filed(classes: DataFrame, hot: Cells | None, large: int, buckets: int, before: int = BEFORE) -> DataFrame:
    """Array rows (bucket, g, c, n, at, s1, s2, side, before, n_before): classes under each of their prefix words.

    before: the prefix words that come before the word g, `before` at most. A hot word is cut in chunks, and g is one of its pairs of
    chunks; side is the class's own chunk where the two differ, else -1: rows of one side don't pair there."""
    shared = classes.sparkSession.sparkContext.broadcast(hot)

    def file(b: pa.RecordBatch) -> pa.RecordBatch:
        row, w = flat(b.column(3))
        length = np.bincount(row, minlength=b.num_rows)
        place = np.arange(len(row)) - (np.cumsum(length) - length)[row]
        g, side, of = w.astype(np.int64), np.full(len(w), -1, np.int64), np.arange(len(w))
        chunks = np.ones(len(w), np.int64) if shared.value is None else np.maximum(1, np.ceil(Cells.at_most(shared.value(_hashed(w))) / (large // 2))).astype(np.int64)
        cut = np.flatnonzero(chunks > 2)
        if len(cut):
            n = chunks[cut]
            own = np.repeat((mix(np.asarray(b.column(0)).view(np.uint64))[row[cut]] % n.astype(np.uint64)).astype(np.int64), n)
            many = np.repeat(cut, n)
            other = np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
            pair = np.minimum(own, other) * chunks[many] + np.maximum(own, other) + 1
            plain = np.flatnonzero(chunks <= 2)
            of = np.concatenate([plain, many])
            g = np.concatenate([g[plain], (mix((g[many] << 32 ^ pair).view(np.uint64)) >> np.uint64(1)).astype(np.int64) | 1 << 62])
            side = np.concatenate([side[plain], np.where(own == other, -1, own)])
        row, place = row[of], place[of]
        first = (np.cumsum(length) - length)[row]
        some = np.minimum(place, before)
        earlier, words = np.repeat(np.arange(len(row)), some), w[spans(first, some)]
        column = lambda i: np.asarray(b.column(i))[row]
        return dealt({"bucket": (mix(g.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), "g": g, "c": column(0), "n": column(1), "at": (place + column(2)).astype(np.int32), "s1": column(4), "s2": column(5), "side": side.astype(np.int32)}, {"before": (earlier, words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 20_000:
                yield file(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
        if sum(x.num_rows for x in held):
            yield file(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = classes.select("c", "n", "skip", "prefix", "s1", "s2")
    return rows.mapInArrow(slimmed(run), "bucket int, g array<long>, c array<long>, n array<int>, at array<int>, s1 array<long>, s2 array<long>, side array<int>, before array<int>, n_before array<int>")


def _short_pairs(start: np.ndarray, end: np.ndarray, to: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier row, later row): all pairs within each of the groups start:end, in strides; to: for each row of all groups the
    row where those that it pairs with end, if that isn't its group's end."""
    size = end - start
    at = spans(start, size)
    to, step = np.repeat(end, size) if to is None else to[at], 1
    while len(at):
        live = np.flatnonzero(at + step < to)
        at, to = at[live], to[live]
        yield at, at + step
        step += 1


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Words that sets of n and m words must share for a Jaccard similarity of 4/5."""
    return (4 * (n + m) + 8) // 9


class Group:
    """Classes under prefix words, sorted by g, and which of them have a candidate."""

    def __init__(self, x: dict[str, np.ndarray]):
        g = x["g"]
        if len(g) and -(1 << 31) <= g.min() and g.max() < 1 << 31:  # no hot words: both fit in one number
            order = np.argsort((g + (1 << 31)).view(np.uint64) << np.uint64(32) | x["n"].astype(np.uint64))
        else:
            order = np.lexsort((x["n"], g))
        n_before = x["n_before"].astype(np.int64)
        first = (np.cumsum(n_before) - n_before)[order]  # of a row's words in x["before"]
        self.x = {k: v[order] for k, v in x.items() if k not in ("before", "n_before")}
        self.x |= {k: self.x[k].view(np.uint64) for k in ("s1", "s2")}  # counting bits takes absolute values of signed numbers
        self.n_before = n_before[order]
        self.first, self.before = first, x["before"].astype(np.int64) & 0xFFFFFFFF
        self.flag = np.zeros(len(order), bool)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows (a, b), broadcast against each other, that length, position and sketch allow."""
        x = self.x
        n, m, i, j = x["n"][a], x["n"][b], x["at"][a], x["at"][b]
        need = needed(n, m)
        ok = (need <= np.minimum(n, m)) & (np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1) >= need) & ((x["side"][a] < 0) | (x["side"][a] != x["side"][b])) & (a != b)
        a, b = np.broadcast_arrays(a, b)
        a, b = a[ok], b[ok]
        most = (n + m - 2 * need)[ok]
        apart = np.bitwise_count(x["s1"][a] ^ x["s1"][b]).astype(np.int64) + np.bitwise_count(x["s2"][a] ^ x["s2"][b])
        return a[apart <= most], b[apart <= most]

    def keep(self, a: np.ndarray, b: np.ndarray) -> None:
        """Flags the rows of pairs that share no word before; pairs of rows that are flagged already make no difference."""
        for s in range(0, len(a), 100_000):
            p, q = a[s : s + 100_000], b[s : s + 100_000]
            new = np.flatnonzero(~(self.flag[p] & self.flag[q]))
            p, q = p[new], q[new]
            rows, of = np.unique(q, return_inverse=True)
            n = self.n_before[rows]
            known = np.sort(np.repeat(np.arange(len(rows)), n) << 32 | self.before[spans(self.first[rows], n)])
            n = self.n_before[p]
            pair = np.repeat(np.arange(len(p)), n)
            want = of[pair] << 32 | self.before[spans(self.first[p], n)]
            shared = np.zeros(len(p), bool)
            if len(want) and len(known):
                shared[pair[known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want]] = True
            self.flag[p[~shared]] = True
            self.flag[q[~shared]] = True

    def flagged(self) -> np.ndarray:
        g = self.x["g"]
        edge = np.flatnonzero(np.diff(g)) + 1
        start, end = np.concatenate([[0], edge]), np.append(edge, len(g))
        few = end - start <= 1024
        # rows lie in order of their length, so those that are short enough for a row end at one place
        size = end - start
        key = np.repeat(np.arange(len(start)), size) << 32 | self.x["n"]
        to = np.searchsorted(key, (key >> 32 << 32) + 5 * self.x["n"].astype(np.int64) // 4, "right")
        pairs, many = [], 0
        for a, b in _short_pairs(start[few & (size > 1)], end[few & (size > 1)], to):
            new = np.flatnonzero(~(self.flag[a] & self.flag[b]))
            pairs.append(self.allowed(a[new], b[new]))
            many += len(pairs[-1][0])
            if many > 100_000:
                self.keep(*map(np.concatenate, zip(*pairs)))
                pairs, many = [], 0
        if pairs:
            self.keep(*map(np.concatenate, zip(*pairs)))
        for s, e in zip(start[~few].tolist(), end[~few].tolist()):
            n = self.x["n"][s:e]
            for a in range(0, e - s, 256):
                most = (5 * int(n[min(a + 256, e - s) - 1])) // 4
                for b in range(a, int(np.searchsorted(n, most, "right")), 1024):
                    rows, others = np.arange(s + a, min(s + a + 256, e)), np.arange(s + b, min(s + b + 1024, e))
                    # rows that have a candidate already only matter to those that have none
                    if self.flag[rows].all():
                        others = others[~self.flag[others]]
                    elif self.flag[others].all():
                        rows = rows[~self.flag[rows]]
                    if len(others):
                        self.keep(*self.allowed(rows[:, None], others[None, :]))
        return np.flatnonzero(self.flag)


def candidates(rows: DataFrame) -> DataFrame:
    """(g, c, at, side): classes with a candidate under g that they share no prefix word with before. rows: of `filed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_bucket(batches):
            group = Group(x)
            hit = group.flagged()
            yield pa.RecordBatch.from_arrays([pa.array(group.x[c][hit]) for c in ("g", "c", "at", "side")], ["g", "c", "at", "side"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(slimmed(run), "g long, c long, at int, side int")


def whole_sets(docs: DataFrame, wanted: DataFrame, rarity, min_words: int) -> DataFrame:
    """(doc_id, t, line_no, words): the sets of the lines at wanted places (doc_id, t, line_no), and of few others, in order
    of rarity, from the texts again; of those only lines that a table of wanted places may hold are cut into words."""

    def values(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = twice(positions(*(np.asarray(c) for c in b.columns)))
        yield h, np.ones(len(h), np.int64)

    spark = docs.sparkSession
    rows = wanted.count()
    places = spark.sparkContext.broadcast(Cells(stored(hash_counts(wanted.select("doc_id", "t", "line_no"), values, buckets_for(spark, rows, 1_000_000)), "places")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t = np.asarray(b.column(0)), np.asarray(b.column(1))
            for p, a in zip(*(lambda parts: (parts, np.cumsum([0, *(x.num_rows for x in parts)])))(list(slices(b, "text", 2 << 20)))):
                lines, doc, line_no = split(p.column(2))
                near = np.flatnonzero(filed_in(places.value, positions(ids[a + doc], t[a + doc], line_no)))
                x = Lines(lines.take(pa.array(near)), min_words, rarity.value)
                at = near[x.at]
                sets = pa.ListArray.from_arrays(pa.array(x.start.astype(np.int32)), pa.array(x.words[x.ids].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + doc[at]]), pa.array(t[a + doc[at]]), pa.array(line_no[at].astype(np.int32)), sets], ["doc_id", "t", "line_no", "words"])

    return docs.mapInArrow(slimmed(run), "doc_id long, t long, line_no int, words array<long>")


class Sets:
    """Classes with their whole sets under prefix words, sorted by g and by their first lines, and their matches."""

    def __init__(self, x: dict[str, np.ndarray], words: np.ndarray, n: np.ndarray):
        order = np.lexsort((x["line_no"], x["t"], x["doc_id"], x["g"]))
        new = np.concatenate([[True], (np.diff(x["g"][order]) != 0) | (np.diff(x["c"][order]) != 0)]) if len(order) else np.zeros(0, bool)
        order = order[new]  # a class once in each group
        first = (np.cumsum(n) - n)[order]
        self.x, self.n = {k: v[order] for k, v in x.items()}, n[order]
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.rows = np.repeat(np.arange(len(order)), self.n)
        self.place = np.arange(len(self.rows)) - self.start[self.rows]
        _, self.ids = np.unique(words[np.repeat(first, self.n) + self.place], return_inverse=True)
        self.early = self.place < self.x["at"][self.rows]
        key = self.rows << 32 | self.ids
        by = np.argsort(key)
        self.key, self.key_place = key[by], self.place[by]
        self.near = np.zeros(len(order), np.int64)
        self.to = np.full(len(order), len(order), np.int64)
        self.label = np.arange(len(order))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def found(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes in matches of earlier rows a and later rows b."""
        self.near += np.bincount(a, self.x["copies"][b], len(self.near)).astype(np.int64) + np.bincount(b, self.x["copies"][a], len(self.near)).astype(np.int64)
        np.minimum.at(self.to, b, a)
        self.edges.append(spanning(self.label, a, b))

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs one by one: b's words are looked up for each word of a."""
        side = self.x["side"]
        ok = (needed(self.n[a], self.n[b]) <= np.minimum(self.n[a], self.n[b])) & ((side[a] < 0) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        step = (np.cumsum(self.n[a]) // (1 << 19)).astype(np.int64)
        for s in np.unique(step).tolist():
            p, q = a[step == s], b[step == s]
            n = self.n[p]
            pair = np.repeat(np.arange(len(p)), n)
            at = spans(self.start[p], n)
            want = q[pair] << 32 | self.ids[at]
            spot = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[spot] == want
            before = hit & self.early[at] & (self.key_place[spot] < self.x["at"][q[pair]])
            good = (np.bincount(pair[hit], minlength=len(p)) >= needed(n, self.n[q])) & (np.bincount(pair[before], minlength=len(p)) == 0)
            self.found(p[good], q[good])

    def dense(self, s: int, e: int) -> None:
        """All pairs of a large group: common words by products of 0/1 matrices, block by block."""
        block = np.unique(np.concatenate([[s], s + np.flatnonzero(np.diff((self.start[s:e] - self.start[s]) // 16384)) + 1, np.arange(s, e, 256), [e]]))
        for a, z in zip(block.tolist(), block[1:].tolist()):
            ids, back = np.unique(self.ids[self.start[a] : self.start[z]], return_inverse=True)
            left = np.zeros((2, z - a, len(ids)), np.float32)
            mine = slice(self.start[a], self.start[z])
            left[0, self.rows[mine] - a, back] = 1
            left[1, self.rows[mine][self.early[mine]] - a, back[self.early[mine]]] = 1
            step = max(1, min(1024, (1 << 23) // len(ids)))
            for b in range(a, e, step):
                y = min(b + step, e)
                other = slice(self.start[b], self.start[y])
                spot = np.minimum(np.searchsorted(ids, self.ids[other]), len(ids) - 1)
                hit = ids[spot] == self.ids[other]
                right = np.zeros((2, y - b, len(ids)), np.float32)
                right[0, self.rows[other][hit] - b, spot[hit]] = 1
                hit &= self.early[other]
                right[1, self.rows[other][hit] - b, spot[hit]] = 1
                rows, others = np.arange(a, z)[:, None], np.arange(b, y)[None, :]
                side = self.x["side"]
                ok = (left[0] @ right[0].T >= needed(self.n[rows], self.n[others])) & (left[1] @ right[1].T < 0.5) & (rows < others) & ((side[rows] < 0) | (side[rows] != side[others]))
                i, j = np.nonzero(ok)
                self.found(i + a, j + b)

    def solve(self) -> pa.RecordBatch:
        g = self.x["g"]
        edge = np.flatnonzero(np.diff(g)) + 1
        start, end = np.concatenate([[0], edge]), np.append(edge, len(g))
        few = end - start <= 48
        for a, b in _short_pairs(start[few], end[few]):
            self.verify(a, b)
        for s, e in zip(start[~few].tolist(), end[~few].tolist()):
            self.dense(s, e)
        hit = np.flatnonzero(self.near)
        to = self.to[hit]
        none = pa.array(to >= len(g))
        of = lambda c: pc.if_else(none, None, pa.array(self.x[c][np.minimum(to, len(g) - 1)]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (zip(*self.edges) if self.edges else ((), ())))
        rows = pa.RecordBatch.from_arrays([pa.array(self.x["c"][hit]), pa.array(self.near[hit]), of("doc_id"), of("t"), of("line_no"), pa.nulls(len(hit), pa.int64())], MATCH)
        links = pa.RecordBatch.from_arrays([pa.array(self.x["c"][a]), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.array(self.x["c"][b])], MATCH)
        return pa.Table.from_batches([rows, links]).combine_chunks().to_batches()


MATCH = ["c", "near", "doc_id", "t", "line_no", "other"]


def matches(rows: DataFrame) -> DataFrame:
    """(c, near, doc_id, t, line_no, other): for each class and group the number of lines that match it there and the
    first line of its earliest match, if one is earlier; and rows with `other`: links that span what matches."""
    names = ["g", "c", "at", "side", "doc_id", "t", "line_no", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g = np.asarray(b.column(0))
            last = int(np.searchsorted(g, g[-1]))
            if last or held and held[-1].column(0)[0].as_py() != g[0]:
                yield from solved([*held, b.slice(0, last)])
                held, b = [], b.slice(last)
            held.append(b)
        if held:
            yield from solved(held)

    def solved(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        words = whole["words"].combine_chunks()
        return Sets({c: np.asarray(whole[c]).astype(np.int32 if c in ("at", "side", "line_no") else np.int64) for c in names}, np.asarray(words.flatten()), np.asarray(pc.list_value_length(words)).astype(np.int64)).solve()

    return rows.select(*names, "words").repartition("g").sortWithinPartitions("g").mapInArrow(slimmed(run), "c long, near long, doc_id long, t long, line_no int, other long")


class Joined(NamedTuple):
    """members: (doc_id, t, line_no, c, o, copies, near, to): the lines of classes with a copy or a match; o: the class's
    first line; to: the first line of its earliest match. links: (c, other) span the matching classes."""

    members: DataFrame
    links: DataFrame


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, large: int = LARGE, before: int = BEFORE) -> Joined:
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), "text")
    counts = stored(hash_counts(docs, _counted(min_words), max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()), 2), "counts")
    of = F.col("h").bitwiseAND(F.lit(3).cast("long"))
    rarity, keys = (spark.sparkContext.broadcast(Cells(counts.where(of == kind))) for kind in (WORD, KEY))
    lines = stored(prefixes(docs, rarity, keys, min_words), "lines", by="again")
    if not counts.where(of == TEXT).isEmpty():  # rows that repeat an id and its text
        several = stored(lines.where("head").groupBy("doc_id", "t").count().where("count > 1"), "several")
        names, place = [c for c in lines.columns if c not in ("doc_id", "t", "line_no")], ["doc_id", "t"]
        once = lines.join(several.select(*place), place, "left_semi").groupBy(*place, "line_no").agg(F.max_by(F.struct(*names), F.size("prefix")).alias("x")).select(*place, "line_no", "x.*")
        lines = stored(lines.join(several.select(*place), place, "left_anti").unionByName(once), "lines", by="again")
    own, place = ["n", "skip", "prefix", "s1", "s2"], F.struct("doc_id", "t", "line_no").alias("o")
    asks = F.size("prefix") > 0
    equal = lines.where("again").groupBy("k", "k2").agg(F.min("c").alias("c"), F.min(place).alias("o"), F.count("*").alias("copies"), F.first(F.when(asks, F.struct(*own)), ignorenulls=True).alias("p"))
    equal = stored(equal, "equal")
    alone = lines.where("not again")
    classes = alone.select("c", "k", "k2", place, F.lit(1).cast("long").alias("copies")).unionByName(equal.drop("p"))
    asked = alone.where(asks).select("c", *own).unionByName(equal.where("p is not null").select("c", "p.*"))
    total = asked.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    rows = filed(asked, hot_words(asked, rarity, large), large, buckets_for(spark, total, 250_000), before)
    near = stored(candidates(rows), "candidates")
    wanted = stored(classes.join(near.select("c").distinct(), "c", "left_semi").select("c", "o.*", "copies"), "wanted")
    asked = near.join(wanted, "c")
    found = stored(matches(whole_sets(docs, wanted, rarity, min_words).join(asked, ["doc_id", "t", "line_no"])), "matches")
    best = found.where("near is not null").groupBy("c").agg(F.sum("near").alias("near"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t", "line_no"))).alias("to"))
    marked = stored(classes.join(best, "c", "left").where("copies > 1 or near is not null"), "marked")
    several = lines.where("again").select("k", "k2", "doc_id", "t", "line_no").join(marked.where("copies > 1"), ["k", "k2"])
    names = ["doc_id", "t", "line_no", "c", "o", "copies", "near", "to"]
    single = marked.where("copies = 1").select("o.*", *names[3:])
    return Joined(stored(several.select(*names).unionByName(single.select(*names)), "members"), found.where("other is not null").select("c", "other"))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, t, line_no, to_doc_id, to_line_no): lines to remove, each with the earliest line that matches it; t: the
    xxhash64 of their text."""
    return removed(joined(docs, doc_id, text, **how))


def removed(x: Joined) -> DataFrame:
    line = F.struct("doc_id", "t", "line_no")
    gone = x.members.where((line != F.col("o")) | F.col("to").isNotNull())
    to = F.least("to", F.when(line != F.col("o"), F.col("o")))
    return gone.select("doc_id", "t", "line_no", to.alias("to")).select("doc_id", "t", "line_no", F.col("to.doc_id").alias("to_doc_id"), F.col("to.line_no").alias("to_line_no"))


def links(x: Joined) -> DataFrame:
    """(doc_id, n_links, class_id) of documents with a match: the number of pairs of a line of the document and another
    line, earlier or later, that match, all of them counted, and the least document reached over matching lines."""
    matching = x.members.where("copies > 1 or near > 0")
    by_doc = matching.groupBy("doc_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    first = x.members.select("c", F.col("o.doc_id").alias("first")).distinct()
    across = x.links.join(first.withColumnRenamed("first", "a"), "c").join(first.select(F.col("c").alias("other"), F.col("first").alias("b")), "other").select("a", "b")
    edges = matching.select(F.col("doc_id").alias("a"), F.col("o.doc_id").alias("b")).where("a <> b").unionByName(across)
    roots = components(edges)
    return by_doc.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_links", F.coalesce("root", "doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, **how) -> DataFrame:
    """docs without the removed lines, the columns as they were; n_chars names a column that follows the text's length."""
    gone_id, gone_t, gone = fresh(docs.columns, "gone_id", "gone_t", "gone")
    by_text = removals(docs, doc_id, text, **how).groupBy(F.col("doc_id").alias(gone_id), F.col("t").alias(gone_t)).agg(F.collect_list("line_no").alias(gone))
    both = docs.join(by_text, (F.col(doc_id).cast("long") == F.col(gone_id)) & (F.xxhash64(text_of(text)) == F.col(gone_t)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    changed = F.col(gone).isNotNull()
    new = {text: F.when(changed, kept).otherwise(F.col(text))}
    if n_chars is not None:
        new[n_chars] = F.when(changed, F.length(kept).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return both.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class (the least document that matching lines reach), the number of all matching pairs of
    its lines, and its removed lines with the earliest line that each matches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = joined(docs)
    gone = removed(found).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "to_doc_id", "to_line_no"))).alias("removed"))
    both = docs.select("doc_id").join(gone, "doc_id", "left").join(links(found), "doc_id", "left")
    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
    return both.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), n_removed.alias("n_removed"), "removed")
