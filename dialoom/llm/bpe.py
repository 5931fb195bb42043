"""Byte-level BPE encoding and decoding with a tokenizer file's merges, by a pair occurrence index.

A slice of a partition's texts is cut into chunks, a run of blanks and what follows it, of which only the distinct ones
that the task hasn't met yet are encoded. All their symbols stand in one array. The index maps each pair of neighbours
that has a rank to all its places; the active ranks are taken in ascending order, every place of a rank is merged, and
the places of the pairs that this makes are filed under their own ranks. A place whose symbols have changed meanwhile
is skipped when its turn comes. Merging a rank never makes a pair of a lower rank (checked as the file is read), so
each rank is taken once.

Chunks: the pre-tokenizer's matches never hold a blank or line feed after another kind of character, nor two kinds of
letters, digits and other signs (but after an apostrophe), and look at what follows only from white space; so a text
may be cut at all such places. Doubtful ones (after control or wide blank characters, beside other than ASCII) stay
uncut, which costs time but never changes a result.

Scale: nothing is shuffled; memory is a slice of 2 MB of text and two generations of CACHED chunks of at most
REMEMBERED bytes each.

Defined results: a null or empty text has no ids, null ids give an empty text; a null id stays null; repeated rows are
coded again; ids that the file lacks are left out in decoding; only the named columns are read; an empty table gives
no rows. The strings of added tokens are found in texts first, as the tokenizers library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import slices, spans, table

CACHED, REMEMBERED, SLICE = 300_000, 64, 2 << 20
#: Chunks that are one piece without asking the pre-tokenizer.
PLAIN = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch


def _kinds() -> np.ndarray:
    """Of each byte: 1 ASCII letter, 2 digit, 3 other printable ASCII, 0 all else."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 3
    for first, last, k in (("A", "Z", 1), ("a", "z", 1), ("0", "9", 2)):
        kind[ord(first) : ord(last) + 1] = k
    return kind


KIND = _kinds()


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: ids of bytes, ranks and results of pairs, added tokens, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, signs = spec["model"]["vocab"], byte_signs()
        of_sign = {s: b for b, s in enumerate(signs)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte_ids = np.asarray([ids[s] for s in signs], np.int32)
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {a << 32 | b: r for r, (a, b, _) in enumerate(self.merges)}
        made = {c: r for r, (_, _, c) in enumerate(self.merges)}
        if len(made) < len(self.merges) or any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(self.merges) for x in (a, b)):
            raise ValueError(f"{path}: a merge needs a token that a later merge makes")
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order
        self.added = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"{path}: the added token {t['content']} takes its surroundings into account")
            self.added[t["content"].encode()] = t["id"]
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        words = {i: w for w, i in ids.items()} | {i: w.decode() for w, i in self.added.items()}
        raw = [b""] * (max(words) + 1)
        for i, w in words.items():
            raw[i] = bytes(of_sign[c] for c in w) if all(c in of_sign for c in w) else w.encode()
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def merged(vocabulary: Vocabulary, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols after all merges inside their pieces, and the piece of each."""
    n = len(symbols)
    if not n:
        return symbols, piece
    joint = np.flatnonzero(piece[:-1] == piece[1:])
    key = symbols[joint].astype(np.int64) << 32 | symbols[joint + 1]
    slot = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
    known = vocabulary.keys[slot] == key if len(vocabulary.keys) else np.zeros(len(key), bool)
    places, rank = joint[known], vocabulary.rank_of[slot[known]]
    order = np.argsort(rank, kind="stable")
    places, rank = places[order], rank[order]
    first = np.flatnonzero(np.diff(rank, prepend=-1))
    index = {r: p.tolist() for r, p in zip(rank[first].tolist(), np.split(places, first[1:]))} if len(first) else {}

    sym = [*symbols.tolist(), -1]  # place n stands for the outside of every piece; -1 is in no pair
    after = np.arange(1, n + 1)
    after[np.flatnonzero(piece[:-1] != piece[1:])] = n
    before = np.arange(-1, n)
    before[np.flatnonzero(np.diff(piece, prepend=-1))] = n
    after, before, of, merges = [*after.tolist(), n], before.tolist(), vocabulary.ranks.get, vocabulary.merges

    def file(pair: int, place: int) -> None:
        r = of(pair)
        if r is not None:
            at = index.get(r)
            if at is None:
                index[r] = [place]
                heapq.heappush(active, r)
            else:
                at.append(place)

    active = list(index)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        a, b, c = merges[r]
        for p in sorted(index.pop(r)):
            q = after[p]
            if sym[p] != a or sym[q] != b:
                continue
            far, near = after[q], before[p]
            sym[p], sym[q], after[p], before[far] = c, -2, far, p
            file(c << 32 | sym[far], p) if far < n else None
            file(sym[near] << 32 | c, near) if near < n else None
    out = np.asarray(sym[:-1], np.int32)
    kept = out >= 0
    return out[kept], piece[kept]


def chunk_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks start: at texts' starts, at blanks and line feeds after what is surely no white space, and between
    ASCII letters, digits and other signs, but not after an apostrophe."""
    kind = KIND[data]
    turn = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 0x27)) + 1
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & np.isin(two, (0x80, 0x81, 0x9A, 0xA0)))
    sure = ((one > 0x20) & (one < 0x7F)) | ((one >= 0x80) & ~wide)
    start = np.zeros(len(data), bool)
    start[np.concatenate([starts, at[sure], turn])] = True
    return np.flatnonzero(start)


class Coder:
    """Encodes arrays of texts; chunks that were met are remembered in two generations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary, self.pieces = Vocabulary(path), Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.byte_of = {s: b for b, s in enumerate(byte_signs())}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _new(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks as bytes of int32."""
        v, pieces, owner = self.vocabulary, [], []
        for k, c in enumerate(chunks):
            if c in v.added:
                continue
            found = [c] if PLAIN(c) else [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.pieces(c.decode())]
            pieces += found
            owner += [k] * len(found)
        symbols = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids, piece = merged(v, symbols, np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces))))
        ends = np.searchsorted(np.asarray(owner, np.int64)[piece] if len(owner) else np.zeros(0, np.int64), np.arange(len(chunks) + 1)).tolist()
        raw = ids.tobytes()
        return {c: np.int32(v.added[c]).tobytes() if c in v.added else raw[4 * a : 4 * b] for c, a, b in zip(chunks, ends, ends[1:])}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = pa.py_buffer(texts.buffers()[2] or b"").slice(int(off[0]), int(off[-1] - off[0]))
        data, off = np.frombuffer(body, np.uint8), off - off[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cuts = chunk_cuts(data, off[:-1][off[:-1] < off[1:]])
        cuts = self._around_added(memoryview(body), cuts, off)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), body]).dictionary_encode()
        values, code = chunks.dictionary.to_pylist(), np.asarray(chunks.indices)
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        ids = {c: self.young.get(c) or self.old.get(c) for c in values}
        ids |= self._new([c for c, x in ids.items() if x is None])
        self.young.update((c, x) for c, x in ids.items() if len(c) <= REMEMBERED)
        n = np.fromiter(map(len, ids.values()), np.int64, len(values)) // 4
        flat, first = np.frombuffer(b"".join(ids.values()), np.int32), np.cumsum(n) - n
        ends = np.concatenate([[0], np.cumsum(n[code])])
        return flat[spans(first[code], n[code])], np.diff(ends[np.searchsorted(cuts, off)])

    def _around_added(self, data: memoryview, cuts: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The cuts with each added token's string as a chunk of its own."""
        if self.vocabulary.special is None:
            return cuts
        hits = np.asarray([m.span() for m in self.vocabulary.special.finditer(data)], np.int64).reshape(-1, 2)
        hits = hits[np.searchsorted(off, hits[:, 0], "right") == np.searchsorted(off, hits[:, 1], "left")]  # not from one text into the next
        if not len(hits):
            return cuts
        k = np.searchsorted(hits[:, 0], cuts, "left") - 1  # the hit that starts before the cut
        inside = (k >= 0) & (cuts < hits[np.maximum(k, 0), 1])
        edges = hits.ravel()
        return np.unique(np.concatenate([cuts[~inside], edges[edges < len(data)]]))


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer)
        for b in batches:
            for part in slices(b, "text", SLICE):
                ids, n = coder(part.column(1))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the texts of id lists, bytes that are no UTF-8 as U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(tokenizer)
        size = np.diff(v.token_ends)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                lists = part.column(1)
                n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                flat = np.asarray(pc.fill_null(lists.flatten(), -1), np.int64)
                known = (flat >= 0) & (flat < len(size))
                flat = np.where(known, flat, 0)
                long = np.where(known, size[flat], 0)
                data = v.token_bytes[spans(v.token_ends[:-1][flat], long)].tobytes()
                ends = np.concatenate([[0], np.cumsum(long)])[np.concatenate([[0], np.cumsum(n)])].tolist()
                texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every document encoded, and decoded again from its ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(joined).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
