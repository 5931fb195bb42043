"""Compression of vectors to codes of a product quantiser over whole numbers, by equal-average search.

Components become floor(4096 x); a vector is cut into `PARTS` equal parts, and every part position has a codebook of
`ENTRIES` entries. A part's nearest entry is found by equal-average search: entries are sorted by the sum of their
components; from the part's own sum the search goes outward, nearer sum first, and ends where the squared gap of sums
over the part's dimension strictly exceeds the best squared distance so far (by Cauchy-Schwarz no entry further out can
be as near). Parts of a batch do this side by side: each step takes the next entry of all that are still searching.

Scale: each round is one scan in which a task adds up its own rows, so PARTS * ENTRIES sums a task are shuffled, added
up as decimals, and as many rows reach the driver; codebooks travel with the tasks (PARTS * ENTRIES entries, whatever
the table's size). Rows aren't written for the rounds: give a stored table where reading it is dear. Errors by label are
added up first and joined back, broadcast if there are at most LABELS of them, else by salted keys.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, as are empty vectors.
All vectors must have one length, a multiple of PARTS (else an error). The first codebook is made of the parts of the
vectors with the smallest ids (nulls last, repeated ids by vector); with fewer than ENTRIES rows it has as many entries
as rows. Repeated rows count each time. A component whose square could leave 64 bits is an error, as `error` is a
long. An empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE, LABELS, SALTS = 8, 16, 6, 4096, 1_000_000, 64
ROWS = 8192


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index. parts (n, d), entries (k, d)."""
    n, d = parts.shape
    totals = entries.sum(1)
    order = np.argsort(totals, kind="stable")
    totals, own = totals[order], parts.sum(1)
    high = np.searchsorted(totals, own)  # the next entry upwards; downwards it is low
    low = high - 1
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    live = np.arange(n)
    while len(live):
        lo, hi = low[live], high[live]
        none = np.iinfo(np.int64).max
        down = np.where(lo >= 0, own[live] - totals[np.maximum(lo, 0)], none)
        up = np.where(hi < len(totals), totals[np.minimum(hi, len(totals) - 1)] - own[live], none)
        gap = np.minimum(down, up)
        # gap^2 / d > best, in whole numbers: gap^2 > best d
        going = (gap < none) & (np.square(np.where(gap < none, gap, 0)) <= np.where(best[live] < none, np.minimum(best[live], none // d) * d, none))
        live, lo, hi, down, up = live[going], lo[going], hi[going], down[going], up[going]
        downward = down <= up
        entry = order[np.where(downward, lo, hi)]
        distance = np.square(parts[live] - entries[entry]).sum(1)
        better = (distance < best[live]) | ((distance == best[live]) & (entry < index[live]))
        at = live[better]
        best[at], index[at] = distance[better], entry[better]
        low[live] -= downward
        high[live] += ~downward
    return index, best


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components as floor(SCALE x)) of a list column: those without null or non-finite components."""
    n = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")))
    row = np.repeat(np.arange(len(n)), n)
    good = (n > 0) & (np.bincount(row, ~np.isfinite(flat), len(n)) == 0)
    kept = np.flatnonzero(good)
    if not len(kept):
        return kept, np.zeros((0, 0), np.int64)
    width = int(n[kept[0]])
    if width % PARTS or (n[kept] != width).any():
        raise ValueError(f"vectors need one length, a multiple of {PARTS}; found {sorted(set(n[kept].tolist()))[:5]}")
    x = np.floor(SCALE * flat[good[row]])
    if max(width, (width // PARTS) ** 2) * (2 * np.abs(x).max()) ** 2 >= 2.0**63:
        raise ValueError("a component is too large for squared distances in 64 bits")
    return kept, x.astype(np.int64).reshape(len(kept), width)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Kept rows of batches and their components (rows, PARTS, width of a part)."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            kept, x = whole_numbers(part.column("vector"))
            if len(kept):
                yield part.take(pa.array(kept)), x.reshape(len(kept), PARTS, -1)


def first_books(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest ids: (PARTS, entries at most, width)."""
    floats = F.transform("vector", lambda x: x.cast("double"))
    good = F.size("vector").cast("int") > 0
    finite = F.forall(floats, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.where(good & finite).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    x = whole_numbers(found.column("vector").combine_chunks())[1]
    return x.reshape(len(x), PARTS, x.shape[1] // PARTS).transpose(1, 0, 2)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean, unused ones as they were."""
    _, k, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(PARTS * k, np.int64), np.zeros((PARTS * k, width), np.int64)
        for _, x in pieces(batches):
            for p in range(PARTS):
                index, _ = nearest(x[:, p], books[p])
                own = slice(p * k, (p + 1) * k)
                n[own] += np.bincount(index, minlength=k)
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                total[own][used] += np.add.reduceat(x[order, p], first, axis=0)
        used = np.flatnonzero(n)
        cell = np.repeat(used * width, width) + np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], width))], ["cell", "total", "n"])

    sums = rows.mapInArrow(add, "cell long, total long, n long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy().reshape(-1)
    for r in sums.collect():  # PARTS * ENTRIES * width cells at most
        out[r.cell] = int(r.total) // r.n
    return out.reshape(books.shape)


def trained(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) of rows (vec_id, vector); none for an empty table."""
    books = first_books(rows)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, x in pieces(batches):
            error, code = np.zeros(len(x), np.int64), np.zeros((len(x), PARTS), np.uint8)
            for p in range(PARTS):
                code[:, p], distance = nearest(x[:, p], books[p])
                error += distance
            digits = code.tobytes().hex()
            texts = [digits[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """The codes with `vector`, the components that they stand for (entries over SCALE)."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.get(F.get(F.lit(books.tolist()), p), F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.withColumn("vector", F.transform(F.flatten(cut), lambda x: x / SCALE))


def label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error, ...) with label_error, the error added up over equal labels (nulls are equal)."""
    names = coded.columns
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = stored(sums, "label-errors")
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")), "left").select(*names, "label_error")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt")), "left").select(*names, "label_error")


def books_sha256(books: np.ndarray) -> str:
    """Of all entries' components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks)."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    books = trained(rows.select("vec_id", "vector"), rounds)
    if not books.shape[1]:
        return rows.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long, label_error long"), books
    return label_errors(stored(encode(rows, books), "codes")), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The query in DuckDB's SQL: plain k-means over whole numbers, all distances worked out."""
    steps = [
        "kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT rid, p, list_transform(range(d), lambda j: CAST(floor({SCALE} * CAST(embedding[p * d + j + 1] AS DOUBLE)) AS BIGINT)) AS v FROM (SELECT *, len(embedding) // {PARTS} AS d FROM kept), range({PARTS}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, v FROM parts WHERE rid <= {ENTRIES})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, p, arg_min(k, (far, k)) AS k, min(far) AS far FROM (SELECT rid, parts.p, k, {distance} AS far FROM parts JOIN b{i} b ON b.p = parts.p) GROUP BY rid, p)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT p, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{i} JOIN parts USING (rid, p)) GROUP BY p, k, j)")
            mean = "(s - (((s % n) + n) % n)) // n"  # rounded down
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(x.v, b.v) AS v FROM b{i} b LEFT JOIN (SELECT p, k, list({mean} ORDER BY j) AS v FROM m{i} GROUP BY p, k) x USING (p, k))")
    digest = f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM b{rounds})"
    coded = f"SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} JOIN kept USING (rid) GROUP BY rid, vec_id, label"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM ({coded})"
