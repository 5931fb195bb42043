"""Losses and rankings that work on arrays, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.functions import arrays as A
from dialoom.operators import scoring


def mean_ce(rows, smoothing=0.05):
    """Mean over all positions that count, by the definition."""
    found = []
    for logits, target in rows:
        logits, target = logits or [], target or []
        if len(target) == 1:
            target = target * len(logits)
        for x, y in zip(logits, target):
            if y:
                lse = math.log(sum(math.exp(v) for v in x))
                found.append((1 - smoothing) * (lse - x[y]) + smoothing * (lse - sum(x) / len(x)))
    return (sum(found) / len(found) if found else 0.0), len(found)


def test_sequences(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(200):
        n, m = int(rng.integers(0, 6)), int(rng.integers(0, 6))
        widths = rng.integers(5, 9, n)
        rows.append((k % 7, [rng.normal(0, 3, w).tolist() for w in widths], [int(x) for x in rng.integers(0, 5, m)]))
    rows += [(0, None, [1]), (1, [[1.0] * 5], None), (9, [[1.0] * 5] * 3, [0, 0, 0]), (10, [], []), (None, [[0.0, 1.0]], [1])]
    got = scoring.token_ce_sequences(spark.createDataFrame(rows, "batch int, logits array<array<double>>, target array<int>").repartition(3), "batch").collect()
    for b, ce, n in got:
        want = mean_ce([r[1:] for r in rows if r[0] == b])
        assert n == want[1] and math.isclose(ce, want[0], abs_tol=1e-12)
    assert len(got) == 10


def test_sequences_without_finite_sums_or_rows_are_zero(spark):
    schema = "logits array<array<double>>, target array<int>"
    bad = [([[float("nan"), 1.0]], [1]), ([[1.0, 2.0]], [1])]
    assert scoring.token_ce_sequences(spark.createDataFrame(bad, schema)).first().ce == 0.0
    assert tuple(scoring.token_ce_sequences(spark.createDataFrame([], schema)).first()) == (0.0, 0)
    with pytest.raises(Exception, match="outside"):
        scoring.token_ce_sequences(spark.createDataFrame([([[1.0, 2.0]], [2])], schema)).collect()


def test_wide_top_k_equals_a_full_sort(spark):
    rng = np.random.default_rng(6)
    nan, inf = float("nan"), float("inf")
    rows = [[float(x) for x in rng.integers(0, high, width)] for high in (2, 5, 1000) for width in (1, 3, 8, 8, 40)]
    rows += [None, [], [nan, 1.0, nan, inf, None, -inf], [None, None], [-inf, None, -inf], [inf, nan, 2.0, inf], [1.0] * 30]
    d = spark.createDataFrame(list(enumerate(rows)), "key int, `odd.name` array<double>")
    for k in (1, 3, 10):
        for key, values, top in scoring.top_k_wide(d.select("key", F.col("`odd.name`").alias("was"), F.col("`odd.name`").alias("values")), k).select("key", "was", "top").collect():
            if values is None:
                assert top is None
                continue
            order = sorted(range(len(values)), key=lambda i: (values[i] is None, not (values[i] is not None and math.isnan(values[i])), -values[i] if values[i] is not None and not math.isnan(values[i]) else 0, i))
            assert [t.id for t in top] == order[:k]
            assert all(t.p == values[t.id] or (values[t.id] is not None and math.isnan(values[t.id]) and math.isnan(t.p)) for t in top)
    with pytest.raises(ValueError):
        scoring.top_k_wide(d, 0)


def test_wide_top_k_of_thirty_thousand_values(spark):
    wide = spark.range(64, numPartitions=4).select("id", F.transform(F.sequence(F.lit(0), F.lit(29_999)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(5_000)).cast("double")).alias("values"))
    both = scoring.top_k_wide(wide.withColumn("was", F.col("values")), 5).withColumn("sorted", A.top_k(F.col("was"), 5))
    assert both.where("transform(top, x -> x.id) <> transform(sorted, x -> x.id)").count() == 0 and both.count() == 64


def test_info_nce_of_batches(spark):
    """Batches that reach over Arrow batches, of several sizes; vectors of zeros count as such."""
    rng = np.random.default_rng(7)
    rows = [(b, r, rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for b, n in enumerate((1, 7, 256, 30)) for r in range(n)]
    rows[3] = (*rows[3][:2], [0.0] * 5, rows[3][3])
    d = spark.createDataFrame(rows, "batch_no long, row int, h_prev array<double>, h_next array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = dict(scoring.info_nce(d).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    assert len(got) == 4
    for b in range(4):
        p, q = (unit(np.array([r[k] for r in rows if r[0] == b])) for k in (2, 3))
        s = q @ p.T / 0.1
        assert math.isclose(got[b], float((np.log(np.exp(s).sum(1)) - np.diag(s)).mean()), rel_tol=1e-9, abs_tol=1e-12)


def test_halves_are_rounded_as_printf_does(spark):
    values = [0.5078125, 0.5234375, -0.5078125, 0.03125, 0.09375, 1234567.25, 2.0000005, -1e-9, 0.0]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", A.fixed(F.col("x"), 6).alias("six"), A.fixed(F.col("x"), 4).alias("four")).collect()
    assert [(r.six, r.four) for r in rows] == [(f"{r.x:.6f}", f"{r.x:.4f}") for r in rows]
