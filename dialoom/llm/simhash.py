"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit where over half of the text's word shingles have it in their XXH64 hash (seed 42; words
lower-cased A-Z, `words` per shingle, repeats counted, joined by blanks; a shorter text is one shingle, one
without words has fingerprint zero). Fingerprints that differ in at most `distance` bits are linked.

Search: equal fingerprints are one class. Correlated bits (their correlation over all classes) are grouped into
m parts; thresholds t(i) >= -1 with sum distance - m + 1 are chosen by dynamic programming on estimated candidate
and probe counts, for the best m, and any linked pair differs in at most t(i) bits of some part i with t(i) >= 0.
Each class is filed under its value of each such part and probes the values near it; candidates in a bucket are
verified on all 64 bits. A bucket gives a spanning forest of its links, not all pairs; buckets over `large` rows
are cut in chunks, and each pair of chunks is a bucket of its own, so no task holds more than two chunks.

Defined results: null texts count as empty; texts without words form one class; a null id has a fingerprint and
never names a component unless all ids there are null; repeated rows are each returned; an empty table gives no
rows; only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import fresh, slices, slimmed, stored, table, text_of
from dialoom.llm.components import components

WORDS, DISTANCE, LARGE = 4, 4, 8192
#: What filing a row (shuffled and sorted) costs, in candidates (one XOR and bit count in a vector).
ROW_COST = 32


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    if not w:
        return []
    if len(w) <= words:
        return [xxh64_intdigest(b" ".join(w), 42)]
    line, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprint_of(hashes: np.ndarray) -> int:
    """Majority bits of one text's hashes, in pieces so that long texts need little memory."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text"):
                out = np.fromiter((fingerprint_of(np.asarray(shingle_hashes(t, words), np.uint64)) for t in p.column(1).to_pylist()), np.uint64, p.num_rows)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(slimmed(run), "doc_id long, fp long")


def moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """(number of classes, 64 x 64 counts of bits set together), over all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            x = np.unpackbits(np.asarray(b.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    rows = classes.select("fp").mapInArrow(slimmed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    both = np.zeros(4096)
    for r in rows:
        both[r.cell] = r.n
    return classes.count(), both.reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each grows by the free bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, parts = list(range(64)), []
    for k in range(m):
        width, own = (64 - 64 * k // m) - (64 - 64 * (k + 1) // m), [free.pop(0)]
        while len(own) < width:
            own.append(free.pop(int(np.argmax(near[np.ix_(own, free)].sum(axis=0)))))
        parts.append(sorted(own))
    return parts


def flips(width: int, t: int) -> list[int]:
    """Bit masks of 1 to t of the width's bits."""
    return [sum(1 << b for b in c) for k in range(1, t + 1) for c in itertools.combinations(range(width), k)]


def allocation(n: int, both: np.ndarray, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """(parts, thresholds) of least estimated cost: candidates, and ROW_COST for each row filed. A part's candidates
    come from the chance that two classes agree on each of its bits, taken as independent within the part."""
    p = np.diag(both) / max(n, 1)
    differ, best = 2 * p * (1 - p), (np.inf, [], [])
    for m in range(2, distance + 2):
        parts, costs = grouped_bits(n, both, m), []
        for bits in parts:
            chance = np.zeros(distance + 1)
            chance[0] = 1
            for b in bits:
                chance = chance * (1 - differ[b]) + np.concatenate([[0], chance[:-1]]) * differ[b]
            rows = np.cumsum([float(math.comb(len(bits), k)) for k in range(distance + 1)])
            rows[1] = 1 + len(bits) / 2  # of two values one bit apart one probes
            costs.append([0.0, *(n * n / 2 * np.cumsum(chance) + ROW_COST * n * rows)])  # threshold -1, 0, 1, ...
        # least cost of the first i parts with thresholds + 1 that sum to s; needed: distance + 1
        table_, choice = [[0.0] + [np.inf] * (distance + 1)], []
        for cost in costs:
            row, pick = [np.inf] * (distance + 2), [0] * (distance + 2)
            for s in range(distance + 2):
                for t in range(min(s, distance) + 1):
                    if table_[-1][s - t] + cost[t] < row[s]:
                        row[s], pick[s] = table_[-1][s - t] + cost[t], t
            table_.append(row)
            choice.append(pick)
        if table_[-1][distance + 1] < best[0]:
            s, found = distance + 1, []
            for pick in reversed(choice):
                found.append(pick[s] - 1)
                s -= pick[s]
            best = (table_[-1][distance + 1], parts, found[::-1])
    return best[1], best[2]


def filed(classes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, fp, own): each class under its own part values (own) and those it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                fp = np.asarray(b.column(0).slice(at, 20_000)).view(np.uint64)
                for i, (bits, t) in enumerate(zip(parts, thresholds)):
                    if t < 0:
                        continue
                    value = np.zeros(len(fp), np.uint64)
                    for k, bit in enumerate(bits):
                        value |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
                    for mask in [0, *flips(len(bits), t)]:
                        # of two values one bit apart only the one without the bit probes
                        use = slice(None) if not mask or t > 1 else value & np.uint64(mask) == 0
                        key = (value[use] ^ np.uint64(mask)).astype(np.int64) | i << 48
                        if len(key):
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[use].view(np.int64)), pa.array(np.full(len(key), not mask))], ["key", "fp", "own"])

    return classes.select("fp").mapInArrow(slimmed(run), "key long, fp long, own boolean")


def forest(fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of one bucket's links with an own row at one end; fp: uint64, own rows first."""
    left, right, rest = [], [], np.arange(len(fp))
    n_own = int(own.sum())
    while len(rest) and rest[0] < n_own:
        seed, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            among = rest if x < n_own else rest[: np.searchsorted(rest, n_own)]
            near = np.bitwise_count(fp[among] ^ fp[x]) <= distance
            if near.any():
                found = among[near]
                left.append(np.full(len(found), fp[x]))
                right.append(fp[found])
                queue += found.tolist()
                gone = np.zeros(len(rest), bool)
                gone[: len(among)] = near
                rest = rest[~gone]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(buckets: DataFrame, distance: int = DISTANCE, small: int = 48) -> DataFrame:
    """(a, b): per bucket a spanning forest of the verified links. buckets: (key, fp, own)."""

    def solve(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, ~own, key))
        key, fp, own = key[order], fp[order], own[order]
        cut = np.flatnonzero(np.diff(key)) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size, mine = end - start, np.add.reduceat(own.astype(np.int64), start) if len(key) else np.zeros(0, np.int64)
        a, b = [], []
        few = (size <= small) & (mine > 0) & (size > 1)
        # all pairs (own row, later row) of small buckets at once, in strides
        if few.any():
            at = np.concatenate([np.arange(s, s + m) for s, m in zip(start[few].tolist(), mine[few].tolist())])
            to = np.repeat(end[few], mine[few])
            for step in range(1, small):
                live = at + step < to
                at, to = at[live], to[live]
                if not len(at):
                    break
                near = np.bitwise_count(fp[at] ^ fp[at + step]) <= distance
                a.append(fp[at[near]])
                b.append(fp[at[near] + step])
        for s, e in zip(start[size > small].tolist(), end[size > small].tolist()):
            x, y = forest(fp[s:e], own[s:e], distance)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.uint64)
        a, b = (np.concatenate([none, *x]).view(np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # whole rows of the key that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, own = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            # rows are sorted by key: all but the batch's last key are complete, and what is held if a new key starts
            last = int(np.searchsorted(key, key[-1]))
            if last or held and held[-1][0][-1] != key[0]:
                done = [*held, (key[:last], fp[:last], own[:last])]
                yield solve(*(np.concatenate(x) for x in zip(*done)))
                held = []
                key, fp, own = key[last:], fp[last:], own[last:]
            held.append((key, fp, own))
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return buckets.mapInArrow(slimmed(run), "a long, b long")


def bucketed(rows: DataFrame, large: int = LARGE) -> DataFrame:
    """The rows with large buckets cut in chunk pairs, dealt and sorted by bucket."""
    big = rows.groupBy("key").count().where(F.col("count") > large).select("key", F.ceil(F.col("count") / (large // 2)).cast("int").alias("chunks"))
    if big.isEmpty():
        whole = rows
    else:
        # at most one row for every `large` filed rows; joined by key, so no size needs to be assumed
        marked = rows.join(big, "key", "left")
        c = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, c).alias("x"), F.greatest(x, c).alias("y")))
        cut = marked.where("chunks is not null").withColumn("p", F.explode(pairs)).select(F.xxhash64("key", "p.x", "p.y").alias("key"), "fp", "own")
        whole = marked.where("chunks is null").select("key", "fp", "own").unionByName(cut)
    return whole.repartition("key").sortWithinPartitions("key")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links reach."""
    marked = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    parts, thresholds = allocation(*moments(classes), distance)
    rows = stored(filed(classes, parts, thresholds), "buckets")
    found = components(links(bucketed(rows, large), distance))
    of = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(of.join(least, "root").select("fp", "component_id"), "fp")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One document of each group, that with the smallest id, all columns. Rows without an id stay."""
    (name,) = fresh(docs.columns, "gone")
    gone = near_duplicates(docs, doc_id, **how).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(gone.distinct(), F.col(doc_id).cast("long") == F.col(name), "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
