"""Losses, decisions and summaries over logged model outputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.arrays import EOS, RATIO, entropy, guarded_gate, has_target

# Loss weights of the corpus format.
POS_WEIGHT, SMOOTHING, ENTROPY_W, BUDGET_W, TAU, NCE_W = 1.2, 0.05, 0.01, 0.1, 0.1, 0.1


def supervised_share(steps: DataFrame) -> DataFrame:
    """Per step: rows, and share of rows with a target token."""
    return steps.groupBy("step").agg(F.count("*").alias("n"), F.round(F.avg(has_target(F.col("target")).cast("double")), 6).alias("share"))


def mean_loss(log: DataFrame, *by: str) -> DataFrame:
    """Sum of losses over number of steps by group; 0 for none."""
    return log.groupBy(*by).agg(F.round(F.coalesce(F.sum("loss") / F.nullif(F.count("loss"), F.lit(0)), F.lit(0.0)), 6).alias("avg_loss"), F.count("loss").alias("steps"))


def component_means(log: DataFrame, *by: str) -> DataFrame:
    """Means of each entry of the map `comps`, per group."""
    return log.select(*by, F.explode("comps").alias("component", "value")).groupBy(*by, "component").agg(F.round(F.sum("value") / F.greatest(F.lit(1), F.count("*")), 6).alias("mean"))


def gate_summary(log: DataFrame, *by: str, temp: float = 1.0) -> DataFrame:
    p = guarded_gate(F.col("logit"), temp)
    return log.groupBy(*by).agg(F.round(F.avg(p), 6).alias("gate_mean"), F.round(F.avg(entropy(p)), 6).alias("gate_entropy"))


def metric_summary(log: DataFrame) -> DataFrame:
    """Per epoch and split of a metrics log: mean, least and number of losses, and the step of the least one."""
    return log.groupBy("epoch", "split").agg(F.round(F.avg("loss"), 6).alias("avg_loss"), F.min("loss").alias("min_loss"), F.count("*").alias("n"), F.min(F.struct("loss", "total_steps"))["total_steps"].alias("best_step"))


def best_so_far(log: DataFrame, by: str, width: int = 4096) -> DataFrame:
    """Least loss before each row (null at first) and whether the row is a new best (strictly less).

    Two passes: the least loss of each bucket of `width` steps, a prefix minimum over that small table, and a window
    inside each bucket."""
    rows = log.withColumn("_b", F.coalesce(F.floor(F.col("total_steps") / width), F.lit(-(1 << 62))).cast("long"))
    earlier = F.min("_min").over(Window.partitionBy("_by").orderBy("_to").rowsBetween(Window.unboundedPreceding, -1))
    buckets = rows.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_to")).agg(F.min("loss").alias("_min")).select("_by", "_to", earlier.alias("_earlier"))
    before = F.min("loss").over(Window.partitionBy(by, "_b").orderBy("total_steps").rowsBetween(Window.unboundedPreceding, -1))
    both = rows.withColumn("_before", before).join(buckets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_to")))
    both = both.withColumn("best_before", F.least("_earlier", "_before")).drop("_b", "_by", "_to", "_before", "_earlier")
    return both.withColumn("new_best", F.col("best_before").isNull() | (F.col("loss") < F.col("best_before")))


def _spoken(log: DataFrame, threshold: float, least: int, most: int, *fields: str) -> DataFrame:
    sized = log.withColumn("cap", F.least(F.count("*").over(Window.partitionBy("conv_id")), F.lit(most)))
    ok = (F.col("t") <= F.col("cap")) & (((F.col("t") >= least) & (F.col("gate") > threshold)) | (F.col("t") == F.col("cap")))
    first = F.min(F.when(ok, F.struct("t", (F.col("gate") <= threshold).alias("forced"), *fields)))
    return sized.groupBy("conv_id").agg(first.alias("s")).select("conv_id", "s.t", "s.forced", *(f"s.{c}" for c in fields))


def speak_step(log: DataFrame, threshold: float, least: int, most: int) -> DataFrame:
    """(conv_id, t, forced): first t (from 1) with t >= least and gate > threshold, else the step where the plan of
    min(steps, most) ends."""
    return _spoken(log, threshold, least, most)


def answers(log: DataFrame, threshold: float, least: int, most: int, decode: DataFrame) -> DataFrame:
    """(conv_id, t, forced, token, answer) of a log (conv_id, t, gate, token), where token is the arg-max of the step's
    logits: the token at the step where `speak_step` speaks, and its word in the table (idx, word): '' for the end mark,
    <UNK> for an id that the table lacks."""
    word = F.when(F.col("token") == EOS, "").otherwise(F.coalesce("word", F.lit("<UNK>")))
    spoken = _spoken(log, threshold, least, most, "token")
    return spoken.join(decode.select("idx", "word"), F.col("token") == F.col("idx"), "left").select("conv_id", "t", "forced", "token", word.alias("answer"))


def batch_speak_step(log: DataFrame, threshold: Column, least: int, most: int, safety: int) -> DataFrame:
    """(batch, t): first t (from 0) whose batch mean of sigmoid gates reaches the threshold after `least` steps, or
    where most or safety force it."""
    means = log.groupBy("batch", "t").agg(F.avg(guarded_gate(F.col("logit"))).alias("p"))
    ok = ((F.col("t") + 1 >= least) & (F.col("p") >= threshold)) | (F.col("t") + 1 >= most) | (F.col("t") + 1 == safety)
    return means.groupBy("batch").agg(F.min(F.when(ok, F.col("t"))).alias("t"))


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def gate_bce(logit: Column, y: Column, weight: float = POS_WEIGHT) -> Column:
    """Binary cross-entropy with logits: y * weight * softplus(-x) + (1 - y) * softplus(x), in its stable form."""
    x = _finite(logit)
    tail = F.log1p(F.exp(-F.abs(x)))
    return y * weight * (F.greatest(-x, F.lit(0.0)) + tail) + (1 - y) * (F.greatest(x, F.lit(0.0)) + tail)


def token_ce(logits: Column, label: Column, smoothing: float = SMOOTHING) -> Column:
    """Smoothed cross-entropy of one row; null where the label is padding."""
    top = F.array_max(logits)
    add = lambda acc, x: acc + x
    lse = top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), add))
    mean = lse - F.aggregate(logits, F.lit(0.0), add) / F.size(logits)
    return F.when(label != 0, (1 - smoothing) * (lse - F.element_at(logits, (label + 1).cast("int"))) + smoothing * mean)


def token_ce_wide(rows: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(key, ce) of rows (key, logits, label) by numpy on Arrow batches, for wide vocabularies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b.logits.to_numpy()).astype(np.float64)
                top = x.max(axis=1, keepdims=True)
                log_p = x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True))
                y = b.label.to_numpy()
                ce = -(1 - smoothing) * log_p[np.arange(len(b)), y] - smoothing * log_p.mean(axis=1)
                yield pd.DataFrame({"key": b.key, "ce": np.where(y != 0, ce, np.nan)})

    return rows.select("key", "logits", "label").mapInPandas(run, "key long, ce double").select("key", F.nanvl("ce", F.lit(None)).alias("ce"))


def token_ce_sequences(rows: DataFrame, *by: str, smoothing: float = SMOOTHING) -> DataFrame:
    """(by..., ce, positions) of rows (by..., logits array<array<double>>, target array<int>): the mean smoothed
    cross-entropy over all positions of a group, where a row's logits and target are cut to the shorter of both and
    padding doesn't count. A target of one id stands for all positions. A group without positions, or whose sum isn't
    finite, has 0. A label that isn't in its position's vocabulary is an error.

    Positions are ragged, and so may vocabularies be: each batch is two flat arrays, reduced by segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logits, target = b.column("logits"), b.column("target")
            n, m = (np.asarray(pc.fill_null(pc.list_value_length(c), 0), np.int64) for c in (logits, target))
            cut = np.where(m == 1, n, np.minimum(n, m))
            position, label_at = (np.cumsum(x) - x for x in (n, m))
            row = np.repeat(np.arange(len(n)), cut)
            j = np.arange(len(row)) - np.repeat(np.cumsum(cut) - cut, cut)
            label = np.asarray(pc.fill_null(target.flatten(), 0), np.int64)[label_at[row] + np.where(m[row] == 1, 0, j)]
            row, j, label = row[label != 0], j[label != 0], label[label != 0]
            inner = logits.flatten()
            width = np.asarray(pc.fill_null(pc.list_value_length(inner), 0), np.int64)
            at = position[row] + j
            size, first = width[at], (np.cumsum(width) - width)[at]
            if len(at) and ((label < 0) | (label >= size)).any():
                raise ValueError("a label lies outside its position's vocabulary")
            flat = np.asarray(pc.fill_null(inner.flatten(), float("nan")), np.float64)
            x = flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            start = np.cumsum(size) - size
            with np.errstate(all="ignore"):
                top = np.maximum.reduceat(x, start) if len(x) else x
                lse = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size)), start)) if len(x) else x
                mean = lse - np.add.reduceat(x, start) / size if len(x) else x
                ce = (1 - smoothing) * (lse - x[start + label]) + smoothing * mean
                total = np.bincount(row, ce, len(n)) if len(row) else np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), pa.array(total), pa.array(np.bincount(row, minlength=len(n)).astype(np.int64))], [*by, "total", "n"])

    picked = rows.select(*by, F.col("logits").cast("array<array<double>>").alias("logits"), F.col("target").cast("array<int>").alias("target"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in by)
    sums = picked.mapInArrow(run, f"{kinds}{', ' if by else ''}total double, n long").groupBy(*by).agg(F.sum("total").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("positions"))
    return sums.select(*by, F.coalesce(_finite(F.col("total") / F.nullif(F.col("positions"), F.lit(0))), F.lit(0.0)).alias("ce"), "positions")


def top_k_wide(rows: DataFrame, k: int, values: str = "values") -> DataFrame:
    """The other columns with `top`, the k largest values as (id, p), ties to the smaller id, without sorting a row: numpy finds the
    k-th largest of all rows of one width at once, and only what reaches it is put in order. NaN is above all numbers,
    null below. For vocabularies of many thousand entries; `arrays.top_k` is the form for narrow ones."""
    if k < 1:
        raise ValueError("k must be positive")
    others = [c for c in rows.columns if c != values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                lists = part.column("_values")
                n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                items = lists.flatten()
                x = np.asarray(pc.fill_null(items, 0.0), np.float64)
                kind = np.where(np.asarray(items.is_null()), 0, np.where(np.isnan(x), 2, 1)).astype(np.int8)
                at = np.cumsum(n) - n
                picked = []
                for width in np.unique(n[n > 0]).tolist():
                    own = np.flatnonzero(n == width)
                    place = at[own][:, None] + np.arange(width)
                    y = np.where(kind[place] == 2, np.inf, np.where(kind[place] == 0, -np.inf, x[place]))
                    line, column = np.nonzero(y >= (np.partition(y, width - k, axis=1)[:, width - k, None] if k < width else -np.inf))
                    flat = place[line, column]
                    order = np.lexsort((column, -np.where(kind[flat] == 1, x[flat], 0), -kind[flat], line))
                    line, column, flat = line[order], column[order], flat[order]
                    rank = np.arange(len(line)) - np.searchsorted(line, line)
                    picked.append((own[line[rank < k]], column[rank < k], flat[rank < k]))
                owner, column, flat = (np.concatenate(c) for c in zip(*picked)) if picked else (np.zeros(0, np.int64),) * 3
                by = np.argsort(owner, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(column[by].astype(np.int32)), items.take(pa.array(flat[by]))], ["id", "p"])
                top = pa.ListArray.from_arrays(pa.array(ends), pairs, mask=lists.is_null() if lists.null_count else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], top], [*others, "top"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.select(*(F.col(f"`{c}`") for c in others), F.col(values).cast("array<double>").alias("_values")).mapInArrow(run, kinds + "top array<struct<id:int,p:double>>")


def entropy_and_budget(log: DataFrame, *by: str, ratio: float = RATIO) -> DataFrame:
    p = guarded_gate(F.col("logit"))
    return log.groupBy(*by).agg(F.round(F.avg(entropy(p)), 6).alias("entropy"), F.round(F.abs(F.avg(p) - ratio), 6).alias("budget"))


def info_nce(rows: DataFrame, tau: float = TAU) -> DataFrame:
    """(batch_no, nce): each row's h_next against every h_prev of its batch (cosine over tau), cross-entropy against
    its own, as one matrix product a batch. rows: (batch_no, row, h_prev, h_next); batches have a fixed size. Vectors of
    zeros or with NaN count as zeros; a batch of vectors of several lengths is an error."""

    def one(held: list[pa.RecordBatch]) -> float:
        sides = []
        for name in ("q", "p"):
            x = pa.concat_arrays([b.column(name) for b in held])
            v = np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
            with np.errstate(all="ignore"):
                sides.append(np.nan_to_num(v / np.sqrt((v * v).sum(1, keepdims=True)), posinf=0.0, neginf=0.0))
        s = sides[0] @ sides[1].T / max(tau, 1e-6)
        top = s.max(1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - np.diag(s)).mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one batch_no, which may reach over Arrow batches
        for b in batches:
            number = np.asarray(b.column("batch_no"))
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            done = []
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if held and held[-1].column("batch_no")[0].as_py() != number[low]:
                    done.append((held[-1].column("batch_no")[0].as_py(), one(held)))
                    held = []
                held.append(b.slice(low, high - low))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done], pa.float64())], ["batch_no", "nce"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0].column("batch_no")[0].as_py()], pa.int64()), pa.array([one(held)])], ["batch_no", "nce"])

    picked = rows.where("batch_no is not null").select(F.col("batch_no").cast("long"), "row", F.col("h_prev").cast("array<double>").alias("p"), F.col("h_next").cast("array<double>").alias("q"))
    return picked.repartition("batch_no").sortWithinPartitions("batch_no", "row").mapInArrow(run, "batch_no long, nce double")


def total_loss(bce: Column, ce: Column, ent: Column, budget: Column, nce: Column) -> Column:
    return bce + ce + ENTROPY_W * ent + BUDGET_W * budget + NCE_W * nce


def replaced(log: DataFrame, *columns: str) -> DataFrame:
    """One row: per column the number of NaN or infinite values, and its sum with those as 0."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return log.agg(*(F.count_if(bad(c)).alias(f"{c}_replaced") for c in columns), *(F.round(F.sum(_finite(F.col(c))), 6).alias(f"{c}_sum") for c in columns))
