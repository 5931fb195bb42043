"""Periodic runs of words, by the branching-tandem test on enhanced suffix arrays, and texts without the repeats.

A run of period q is a stretch of words whose smallest period is q, as long as the rule `long_enough` asks, and which no
neighbouring word extends. Where a run ends, its last square (two periods, at i) is a branching tandem repeat: the
suffixes i and i + q have a longest common prefix of exactly q. Such a pair is parted by one node of value q in the LCP
array; so for each node, of the two rank ranges beside it the smaller one's suffixes are taken, and ISA[i + q] or
ISA[i - q] is looked up in the other one. That is n log n tests at most and no tree is built: two boundaries a node
come from one pass with a stack. A square found is rotated to the left, in blocks that grow, as long as the words agree;
the rotations merge into the run that they cover. Squares with one end are taken by rising period: those whose period is
a multiple of a run's that covers them aren't primitive, and are left out before they are rotated.

Suffix arrays come from prefix doubling in numpy, for all texts of a slice at once: words are numbered by text, so no two
texts share a prefix. Ranks of all doubling rounds are kept, and give the LCPs of neighbours by binary descent.

Scale: nothing is shuffled, a task takes slices of SLICE bytes of text, or one text; a text of n words needs about
4 n (rounds + 20) bytes, where rounds is log2 of its longest repeat.

Defined results: a null, empty or blank text has no runs and collapses to ''; repeated rows are searched again; a null id
stays null; only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import Words, slices, spans, table, text_of

LEAST, TIMES, SLICE = 6, 4, 1 << 20


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(SA, ranks): the suffixes of a number array in order, and for each k the ranks of all runs of 2**k words (the
    last ones are equal for no two)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.diff(words[order], prepend=-1) != 0
    first = np.flatnonzero(new)
    head = first[np.cumsum(new) - 1]  # where each slot's group starts
    rank = np.empty(n, np.int32)
    rank[order] = head
    ranks, k = [rank.copy()], 1
    open_ = np.flatnonzero(np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n))))  # slots of groups of two and more
    while len(open_):
        at = order[open_]
        second = np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1).astype(np.int64)
        key = rank[at].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.diff(key, prepend=-1) != 0
        first = np.flatnonzero(new)
        rank[at] = open_[first][np.cumsum(new) - 1]
        size = np.diff(np.append(first, len(at)))
        open_ = open_[np.repeat(size > 1, size)]
        ranks.append(rank.copy())
        k *= 2
    return order, ranks


def neighbour_lcps(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """LCP[j] of the suffixes at ranks j - 1 and j; LCP[0] is 0."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    j = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[j - 1].copy(), order[j].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a, b = a + step, b + step
        lcp[j] += step
    return lcp


def boundaries(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(j, left, right) of all nodes j with LCP[j] > 0: the suffixes of ranks left..j-1 and j..right share LCP[j] words.
    Of equal values in one interval the first is above the others."""
    nodes = np.flatnonzero(lcp > 0)
    left, right = np.empty(len(nodes), np.int64), np.empty(len(nodes), np.int64)
    stack: list[int] = []  # places in nodes, values not falling
    at, value, last = nodes.tolist(), lcp[nodes].tolist(), -2
    lows, highs = [0] * len(at), [0] * len(at)
    for x, j in enumerate(at):
        if j != last + 1:  # a value of 0 came before
            for y in stack:
                highs[y] = last
            stack, base = [], j - 1
        v = value[x]
        while stack and value[stack[-1]] > v:
            highs[stack.pop()] = last
        lows[x] = at[stack[-1]] if stack else base
        stack.append(x)
        last = j
    for y in stack:
        highs[y] = last
    left[:], right[:] = lows, highs
    return nodes, left, right


def branching_tandems(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, q): all i where words i..i+2q are a square that the next word doesn't rotate."""
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    node, left, right = boundaries(lcp)
    below = node - left <= right - node + 1  # the left side is the smaller one
    first, size = np.where(below, left, node), np.where(below, node - left, right - node + 1)
    far_first, far_last = np.where(below, node, left), np.where(below, right, node - 1)
    starts, periods = [], []
    for a, z in _portions(size):
        i = order[spans(first[a:z], size[a:z])]
        q, lo, hi = (np.repeat(x[a:z], size[a:z]) for x in (lcp[node], far_first, far_last))
        for step in (q, -q):
            other = i + step
            rank = inverse[np.clip(other, 0, n - 1)]
            hit = (other >= 0) & (other < n) & (rank >= lo) & (rank <= hi)
            starts.append(np.minimum(i, other)[hit])
            periods.append(q[hit])
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _portions(size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of nodes whose sizes add up to about `most`."""
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    yield from ((a, z) for a, z in zip(cuts, cuts[1:]) if z > a)


def rotated(words: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far each square (i, q) rotates to the left."""
    turns, live, block = np.zeros(len(i), np.int64), np.arange(len(i)), 8
    while len(live):
        for part in np.array_split(live, max(1, len(live) * block >> 20)):
            at = (i[part] - turns[part])[:, None] - np.arange(1, block + 1)
            same = (at >= 0) & (words[np.maximum(at, 0)] == words[np.maximum(at, 0) + q[part][:, None]])
            turns[part] += np.where(same.all(1), block, same.argmin(1))
        live = live[(turns[live] % 8 == 0) & (turns[live] >= block) & _whole(words, i[live], q[live], turns[live])]
        block = min(block * 4, 4096)
    return turns


def _whole(words: np.ndarray, i: np.ndarray, q: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Whether the next rotation is possible too."""
    at = i - turns - 1
    return (at >= 0) & (words[np.maximum(at, 0)] == words[np.maximum(at, 0) + q])


def primitive_runs(words: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs that hold the squares (i, q). Only a few primitive squares end at one place,
    so there are only a few rounds."""
    end = i + 2 * q
    by = np.lexsort((q, end))
    i, q, end = i[by], q[by], end[by]
    found = []
    while len(i):
        first = np.diff(end, prepend=-1) != 0
        turns = rotated(words, i[first], q[first])
        length = turns + 2 * q[first]
        found.append((i[first] - turns, length, q[first]))
        of = np.cumsum(first) - 1
        left = ~first & ~((q % q[first][of] == 0) & (2 * q <= length[of]))
        i, q, end = i[left], q[left], end[left]
    none = [np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(none)


def long_enough(length: np.ndarray, period: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    return length >= np.maximum(least, times * period)


def all_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, in order of start and period. words: numbers, those of one text differ from
    all others'. times: 2 or more."""
    none = np.zeros(0, np.int64)
    if len(words) < 2:
        return none, none, none
    order, ranks = suffix_order(words)
    lcp = neighbour_lcps(order, ranks)
    del ranks
    i, q = branching_tandems(order, lcp)
    start, length, q = primitive_runs(words, i, q)
    kept = long_enough(length, q, least, times)
    start, length, q = start[kept], length[kept], q[kept]
    by = np.lexsort((q, start))
    return start[by], length[by], q[by]


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>> by start and period, collapsed text): words that a run holds
    after its first period are left out of the collapsed text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE):
                w = Words(part.column(1), lower=False)
                number = np.unique(w.rows() * max(1, len(w.words)) + w.ids, return_inverse=True)[1].ravel()
                start, length, period = all_runs(number, least, times)
                dropped = np.zeros(len(number) + 1, np.int64)
                np.add.at(dropped, start + period, 1)
                np.add.at(dropped, start + length, -1)
                kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
                ends = np.searchsorted(kept, w.start).astype(np.int32)
                words = w.words.take(pa.array(w.ids[kept]))
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), pa.scalar(" ", pa.large_string())).cast(pa.string())
                owner = np.searchsorted(w.start, start, "right") - 1
                cut = np.searchsorted(start, w.start).astype(np.int32)
                fields = [pa.array(x.astype(np.int64)) for x in (start - w.start[owner], length, period)]
                found = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column(0), found, collapsed], ["doc_id", "runs", "collapsed"])

    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    return picked.mapInArrow(search, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in which a tenth of the documents repeat a stretch of words up to their end."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    g = F.floor(h / 10)

    def bound(value: Column, use) -> Column:
        """use(value), where the value is worked out once: a name inside another lambda would be expanded there."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def tail(w: Column) -> Column:
        n = F.size(w["words"]).cast("long")
        a = F.pmod(g, n)
        return bound(F.struct(w["words"].alias("words"), n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p")), whole)

    def whole(s: Column) -> Column:
        first = F.slice(s["words"], F.lit(1), s["a"].cast("int"))
        rest = F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - s["a"] - 1), lambda k: F.get(s["words"], (s["a"] + F.pmod(k, s["p"])).cast("int")))
        return F.array_join(F.concat(first, rest), " ")

    repeating = bound(F.struct(words.alias("words")), lambda w: F.when(F.size(w["words"]) > 0, tail(w)))
    return F.coalesce(F.when(h % 10 == 0, repeating), text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs(docs.select("doc_id", planted(F.col("doc_id"), text_of()).alias("text")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # by start and period; a later run has to be better
    best = F.aggregate("runs", none, lambda acc, r: F.when(acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
