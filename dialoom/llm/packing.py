"""Order-preserving packing of token streams into windows of at most `size` tokens.

The documents of an input partition follow each other, each ended by id `end`. Windows are cut by dynamic
programming over the places where a cut may fall: ends of documents (free), ends of sentences and lines
(penalty `sentence`), and every `stride` tokens where no such place comes (penalty `forced`). The cost of a
window is its padding plus the penalty of the cut at its end; f(j) = penalty(j) + size - pos(j) +
min(f(i) + pos(i)) over the places i at most `size` tokens before j, and that sliding minimum is a monotone
queue. A block's rest, shorter than a window, goes into windows of powers of two, which need no padding.

Scale: nothing is shuffled; a task packs its own rows, in blocks of about `block` tokens, and numbers its
windows under its own prefix. Rows keep their input order; give a range-sorted table where another is wanted.

Defined results: a null or empty text is just its end id; repeated rows are packed again; a null id stays null;
a text longer than a window is cut; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import slices, slimmed, table

SIZE, END, STRIDE, SENTENCE, FORCED, BLOCK = 2048, 1, 16, 2, 6, 1 << 19
#: Ids of the byte-level vocabulary after which a sentence or line ends: ! . ? and the line feed.
LINE_FEED = 198
STOPS = (0, 13, 30, LINE_FEED)
CACHED = 300_000


@lru_cache(maxsize=1)
def _coders(path: str, ranks: str | None):
    """The tokenizer file and the faster coder, loaded once for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not ranks:
        return Tokenizer.from_file(path), None
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as lines:
        of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Tokenizer.from_file(path), tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=of, special_tokens={})


class Encoder:
    """Ids of a byte-level BPE tokenizer file. In texts whose words are parted by single blanks and line feeds,
    the pieces between blanks can be encoded on their own, as the pre-tokenizer cuts there; they are remembered
    in two generations of bounded size. New pieces go through `ranks`, a faster coder of the same vocabulary,
    where that is given. All other texts go through the tokenizer file whole."""

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer, self.fast = _coders(path, ranks)
        self.young, self.old = {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> None:
        plain = [x for x in pieces if x and x != "\n" and "<|" not in x] if self.fast else []
        if plain:
            ids = self.fast.encode_to_numpy("\n".join(plain)).astype(np.uint32)
            cut = np.flatnonzero(ids == LINE_FEED)
            if len(cut) == len(plain) - 1:
                raw, edge = ids.tobytes(), [-1, *cut.tolist(), len(ids)]
                self.young.update((x, raw[4 * a + 4 : 4 * b]) for x, a, b in zip(plain, edge, edge[1:]))
        rest = [x for x in pieces if x not in self.young]
        self.young.update(zip(rest, self._whole(rest)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        plans, odd = [], []
        for t in texts:
            t = t or ""
            if t and " ".join(t.split()) == t.replace("\n", " "):
                plans.append(_pieces(t))
            else:
                plans.append(None)
                odd.append(t)
        young, old = self.young, self.old
        new = list({x for p in plans if p is not None for x in p if x not in young})
        if new:
            young.update((x, old[x]) for x in new if x in old)
            self._new([x for x in new if x not in old])
        rest = iter(self._whole(odd) if odd else [])
        return [next(rest) if p is None else b"".join(map(young.__getitem__, p)) for p in plans]


def _pieces(text: str) -> list[str]:
    """Words with the blank before them, line feeds, and words at the start of a line."""
    out: list[str] = []
    for line in text.split("\n"):
        first, *more = line.split(" ")
        out += ["\n", first, *[" " + w for w in more]]
    return out[1:]


def windows(cuts: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Positions at which windows end: the cheapest choice among `cuts` (ascending, the last is the stream's end).
    The last window costs nothing: what it holds is cut up without padding."""
    pos, pen = [0, *cuts.tolist()], [0, *penalty.tolist()]
    g, back, queue = [0] * len(pos), [0] * len(pos), deque([0])
    for j in range(1, len(pos)):
        p = pos[j]
        while p - pos[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        x = g[i] + size + pen[j]  # f(j) + pos(j)
        g[j] = x
        while queue and g[queue[-1]] >= x:
            queue.pop()
        queue.append(j)
    last = len(pos) - 1
    inside = range(bisect.bisect_left(pos, pos[last] - size), last)
    back[last] = min(inside, key=lambda i: (g[i] - pos[i], -i))  # f(i) alone
    out, j = [], last
    while j > 0:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def plan(ids: np.ndarray, ends: np.ndarray, size: int = SIZE, stride: int = STRIDE, sentence: int = SENTENCE, forced: int = FORCED) -> np.ndarray:
    """Window ends for one block of tokens whose documents end at `ends`."""
    total = len(ids)
    stops = np.flatnonzero(np.isin(ids, STOPS)) + 1
    cost = np.full(total + 1, -1, np.int64)
    cost[stops] = sentence
    cost[ends] = 0
    places = np.flatnonzero(cost >= 0)
    places = places[places > 0]
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > stride)
    extra = [np.arange(places[k] - gaps[k] + stride, places[k], stride) for k in wide.tolist()]
    if extra:
        at = np.concatenate(extra)
        cost[at] = forced
        places = np.union1d(places, at)
    found = windows(places, cost[places], size)
    last = found[-2] if len(found) > 1 else 0
    rest, out = total - last, found[:-1]
    while rest:  # a full window, or powers of two
        take = size if rest >= size else 1 << (rest.bit_length() - 1)
        last += take
        rest -= take
        out.append(last)
    return np.asarray(out, np.int64)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of every document."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def emit(keys: list, streams: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.asarray([len(x) for x in streams], np.int64)
        ids, ends = np.concatenate(streams), np.cumsum(lengths)
        close = plan(ids, ends, size)
        stops = np.union1d(ends, close)
        starts = np.concatenate([[0], stops[:-1]])
        doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(close, starts, "right")
        opens = np.concatenate([[0], close[:-1]])
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
        columns = [pa.array(keys, pa.int64()).take(pa.array(doc)), *map(pa.array, (starts - (ends - lengths)[doc], stops - starts, np.asarray(crc, np.int64), lengths[doc], first + seq, starts - opens[seq]))]
        if with_ids:
            columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, stops)], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids), first + len(close)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder(tokenizer, ranks), np.asarray([end], np.uint32)
        first, keys, streams, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for part in slices(b, "text", 2 << 20):
                for key, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    keys.append(key)
                    streams.append(np.concatenate([np.frombuffer(raw, np.uint32), tail]))
                    held += len(streams[-1])
                    if held >= block:
                        out, first = emit(keys, streams, first)
                        keys, streams, held = [], [], 0
                        yield out
        if keys:
            yield emit(keys, streams, first)[0]

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids
    return picked.mapInArrow(slimmed(run), schema)


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *tokenizer_files())
