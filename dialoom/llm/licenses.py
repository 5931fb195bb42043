"""Licence scan: winnowed fingerprints pick candidate templates, banded alignment reports what they cover.

Words are lower-cased and stripped of ASCII punctuation at their ends; words of nothing else drop out. Hashes of
runs of `k` words are winnowed (the smallest of each `window` runs in a row, rightmost on ties), for templates
and texts alike, so a shared run of k + window - 1 words always shares a fingerprint. An inverted index of the
templates' fingerprints, which has a fixed size, is broadcast. Shared fingerprints near one diagonal make one
candidate place; a banded local alignment there gives the matched words. A place is reported where it covers
`coverage` of its template; of places that overlap, the one with more matched words stays (then the higher
coverage, then the smaller name).

Defined results: null and empty texts have no spans; templates under k words can't match; repeated rows are each
reported; an empty table gives no rows; only the named columns are read. Spans count the text's words (those
with a letter or digit), from 0, the end not included.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import Words, mix, rolled, slices, table
from dialoom.llm.templates import LICENSES

K, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.8
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Coded:
    """Words of texts, stripped, as codes of a vocabulary (-1: not in it)."""

    def __init__(self, texts: pa.Array, vocabulary: pa.Array | None = None):
        w = Words(texts)
        bare = pc.utf8_trim(w.words, STRIP)
        self.vocabulary = pc.unique(bare).filter(pc.not_equal(pc.unique(bare), "")) if vocabulary is None else vocabulary
        code = np.asarray(pc.fill_null(pc.index_in(bare, value_set=self.vocabulary), -1), np.int64)
        empty = np.asarray(pc.equal(bare, ""), bool)[w.ids] if len(w.ids) else np.zeros(0, bool)
        kept = np.concatenate([[0], np.cumsum(~empty)])
        self.codes, self.start = code[w.ids][~empty], kept[w.start]


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the chosen hashes of one text."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= window:
        return np.asarray([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (np.argmin(view, axis=1) + np.arange(len(view))))


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Matched (text position, template position) of the best local alignment whose diagonals are within `band`
    of `shift` (text position less template position): match 2, mismatch or gap -1."""
    n, m, width = len(text), len(template), 2 * band + 1
    score, step = np.zeros((m + 1, width + 2), np.int32), np.zeros((m + 1, width + 2), np.int8)
    best, at = 0, (0, 0)
    for q in range(1, m + 1):
        first = q - 1 + shift - band  # the text position of the row's first cell
        low, high = max(0, -first), min(width, n - first)
        if low >= high:
            continue
        own = slice(low + 1, high + 1)
        diagonal = score[q - 1, own] + np.where(text[first + low : first + high] == template[q - 1], 2, -1)
        down = score[q - 1, low + 2 : high + 2] - 1
        d = np.arange(high - low)
        s = np.maximum.accumulate(np.maximum(np.maximum(diagonal, down), 0) + d) - d  # steps along the row included
        along = np.concatenate([[-1], s[:-1] - 1])
        score[q, own], step[q, own] = s, np.where(s == 0, 0, np.where(diagonal == s, 1, np.where(along == s, 2, 3)))
        k = int(np.argmax(s))
        if s[k] > best:
            best, at = int(s[k]), (q, low + 1 + k)
    (q, d), pairs = at, []
    while q > 0 and score[q, d] > 0:
        if step[q, d] == 1:
            p = q - 1 + shift + d - 1 - band
            if text[p] == template[q - 1]:
                pairs.append((p, q - 1))
            q -= 1
        elif step[q, d] == 2:
            d -= 1
        elif step[q, d] == 3:
            q, d = q - 1, d + 1
        else:
            break
    return pairs[::-1]


def whole(text: np.ndarray, template: np.ndarray, shift: int, band: int) -> int | None:
    """Where the template stands word for word, on the first such diagonal within `band` of `shift`; else None."""
    low, high = max(0, shift - band), min(len(text) - len(template), shift + band)
    if low > high:
        return None
    same = (np.lib.stride_tricks.sliding_window_view(text[low : high + len(template)], len(template)) == template).all(axis=1)
    return low + int(np.argmax(same)) if same.any() else None


class Templates:
    def __init__(self, texts: dict[str, str], k: int = K, window: int = WINDOW):
        self.names, self.k, self.window = sorted(texts), k, window
        c = _Coded(pa.array([texts[x] for x in self.names], pa.large_string()))
        self.vocabulary = c.vocabulary
        self.texts = [c.codes[a:b] for a, b in zip(c.start, c.start[1:])]
        rows = [(int(h[p]), i, int(p)) for i, t in enumerate(self.texts) for h in [self._hashes(t)] for p in winnow(h, window).tolist()]
        rows.sort()
        self.runs, self.of, self.at = (np.asarray([r[x] for r in rows], np.uint64 if x == 0 else np.int64) for x in range(3))

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        return rolled(mix(codes.astype(np.uint64) + np.uint64(2)), self.k)

    def places(self, codes: np.ndarray, band: int, coverage: float) -> list[tuple[int, int, int, int, float]]:
        """(template, first word, end word, matched, coverage) in one text."""
        h = self._hashes(codes)
        chosen = winnow(h, self.window)
        low, high = np.searchsorted(self.runs, h[chosen], "left"), np.searchsorted(self.runs, h[chosen], "right")
        shifts: dict[int, list[int]] = {}
        for c in np.flatnonzero(high > low).tolist():
            for r in range(low[c], high[c]):
                shifts.setdefault(int(self.of[r]), []).append(int(chosen[c]) - int(self.at[r]))
        found = []
        for i, all_shifts in shifts.items():
            last, free = None, codes.copy()
            for s in sorted(set(all_shifts)):
                if last is not None and s - last <= band // 2:
                    continue
                last, t = s, self.texts[i]
                lo, hi = max(0, s - band), min(len(codes), s + len(t) + band)
                while True:  # words of a place that is found don't match again, so that its neighbours are found too
                    if np.isin(free[lo:hi], t).sum() < coverage * len(t):
                        break  # too few words for any alignment
                    p = whole(free[lo:hi], t, s - lo, band)  # nothing aligns better than all words in a row
                    pairs = align(free[lo:hi], t, s - lo, band) if p is None else [(p + k, k) for k in range(len(t))]
                    if not pairs or len(pairs) < coverage * len(t):
                        break
                    found.append((i, lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs), len(pairs) / len(t)))
                    free[lo + pairs[0][0] : lo + pairs[-1][0] + 1] = -2
        kept: list[tuple[int, int, int, int, float]] = []
        starts: list[int] = []  # of kept, which don't overlap, in order
        for x in sorted(found, key=lambda x: (-x[3], -x[4], self.names[x[0]], x[1])):
            k = bisect.bisect_left(starts, x[2])  # those before k start before x ends
            if not k or kept[k - 1][2] <= x[1]:
                kept.insert(k, x)
                starts.insert(k, x[1])
        return kept


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, k: int = K, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, first_word, end_word, matched, coverage): one row for each place."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(LICENSES if templates is None else templates, k, window))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for part in slices(b, "text"):
                c = _Coded(part.column(1), own.vocabulary)
                good = np.concatenate([[0], np.cumsum(c.codes >= 0)])
                spots = np.flatnonzero(good[own.k :] - good[: -own.k] == own.k) if len(good) > own.k else []
                rows = []
                for d in np.unique(np.searchsorted(c.start, spots, "right") - 1).tolist():
                    rows += [(d, *x) for x in own.places(c.codes[c.start[d] : c.start[d + 1]], band, coverage)]
                pick = lambda x, kind: pa.array([r[x] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick(0, pa.int64())), pa.array([own.names[r[1]] for r in rows], pa.string()), pick(2, pa.int32()), pick(3, pa.int32()), pick(4, pa.int32()), pick(5, pa.float64())], ["doc_id", "license", "first_word", "end_word", "matched", "coverage"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(find, "doc_id long, license string, first_word int, end_word int, matched int, coverage double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
