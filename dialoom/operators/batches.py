"""Batches, training rows and samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from dialoom.functions.arrays import context, has_target, padded, rendered, unpadded


def collate_reference(dialogues: DataFrame) -> DataFrame:
    """(batch_no, row, x_ref) padded to the batch's longest; dialogues (batch_no, row, x_ref)."""
    return dialogues.select("batch_no", "row", padded(F.col("x_ref"), F.max(F.size("x_ref")).over(Window.partitionBy("batch_no"))).alias("x_ref"))


def collate(dialogues: DataFrame, steps: DataFrame) -> DataFrame:
    """(batch_no, step, row, x_t, target, gate): steps aligned to the batch's longest dialogue. A missing step is
    empty with gate 0; a whole step's x_t (target) is null if no row of the batch has tokens there.

    dialogues: (batch_no, row); steps: (batch_no, row, step, x_t, target, gate). One shuffle by batch_no: dialogues go with
    the steps as rows of step -1, which then turn into the steps that they lack."""
    names, none = ["batch_no", "row", "step", "x_t", "target", "gate"], F.array().cast("array<int>")
    marks = dialogues.select("batch_no", "row", F.lit(-1).cast(steps.schema["step"].dataType).alias("step"))
    whole = steps.select(*names).unionByName(marks, allowMissingColumns=True).repartition("batch_no")
    own = Window.partitionBy("batch_no", "row")
    whole = whole.withColumns({"_last": F.max("step").over(Window.partitionBy("batch_no")), "_have": F.collect_set("step").over(own), "_known": F.min("step").over(own) == -1}).where("_known and _last >= 0")
    lacks = F.array_except(F.sequence(F.lit(0).cast(steps.schema["step"].dataType), "_last"), "_have")
    full = whole.select("batch_no", "row", F.explode(F.when(F.col("step") == -1, lacks).otherwise(F.array("step"))).alias("step"), F.coalesce("x_t", none).alias("x_t"), F.coalesce("target", none).alias("target"), F.coalesce("gate", F.lit(0.0)).alias("gate"))
    w = Window.partitionBy("batch_no", "step")
    pad = lambda c: F.when(F.max(F.size(c)).over(w) > 0, padded(F.col(c), F.max(F.size(c)).over(w)))
    return full.select("batch_no", "step", "row", pad("x_t").alias("x_t"), pad("target").alias("target"), "gate")


def collate_with(dialogues: DataFrame, steps: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Batches made by a function of one's own in place of `collate`: it gets all steps of a batch as a pandas frame with
    dialogues' and steps' columns, in order of row and step, and gives rows of the schema. A batch has a fixed number of
    dialogues, so it is what one call can hold. dialogues: (batch_no, row, ...); steps: (batch_no, row, step, ...)."""
    more = [c for c in dialogues.columns if c not in steps.columns]
    whole = steps.join(dialogues.select("batch_no", "row", *more), ["batch_no", "row"])

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        return function(batch.sort_values(["row", "step"], ignore_index=True))

    return whole.groupBy("batch_no").applyInPandas(one, schema)


def final_target(steps: DataFrame, with_tokens: bool = False) -> DataFrame:
    """(conv_id, final): a dialogue's last non-null target, or its last with a token that isn't padding."""
    ok = F.col("target").isNotNull() & (has_target(F.col("target")) if with_tokens else F.lit(True))
    return steps.groupBy("conv_id").agg(F.max_by(F.when(ok, F.col("target")), F.when(ok, F.col("step"))).alias("final"))


def extended(steps: DataFrame, least: int, most: int, to_most: bool, safety: int | None = None) -> DataFrame:
    """(conv_id, step, target): the plan of max(n, least) (to_most: at least `most`) steps, at most `most`; extra
    steps are empty, and the safety step (step + 1 = safety) takes the final target when it has none."""
    n = F.least(F.greatest(F.max("step") + 1, F.lit(least)), F.lit(most))
    run = steps.groupBy("conv_id").agg((F.greatest(n, F.lit(most)) if to_most else n).cast("int").alias("n"))
    frame = run.select("conv_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    out = frame.join(steps.select("conv_id", "step", "target"), ["conv_id", "step"], "left")
    if safety is None:
        return out
    out = out.join(final_target(steps, with_tokens=True), "conv_id")
    take = (F.col("step") + 1 == safety) & ~has_target(F.col("target"))
    return out.select("conv_id", "step", F.when(take, F.col("final")).otherwise(F.col("target")).alias("target"))


def pairs(steps: DataFrame) -> DataFrame:
    """Steps with a target to learn from: those of nothing but padding are dropped."""
    return steps.where(has_target(F.col("target")))


def forced_places(steps: DataFrame) -> DataFrame:
    """(conv_id, step, context, target, places array<int>): one row for each step that has a target; `places` are those of
    its tokens. What is learned at place j is target[j] after target[:j], which `prefix_at` cuts where it is used: rows
    of all prefixes would hold a number of ids that is quadratic in the target's length."""
    out = pairs(steps).select("conv_id", "step", context(F.col("x_t"), F.col("x_ref")).alias("context"), unpadded(F.col("target")).alias("target"))
    return out.withColumn("places", F.sequence(F.lit(0), F.size("target") - 1))


def prefix_at(target: Column, j: Column) -> Column:
    """The ids before place j; null at the first place."""
    return F.when(j > 0, F.slice(target, F.lit(1), j))


def forced(steps: DataFrame) -> DataFrame:
    """(conv_id, step, context, j, prefix, gold): one row for each target token."""
    out = forced_places(steps).select("conv_id", "step", "context", "target", F.explode("places").alias("j"))
    return out.select("conv_id", "step", "context", "j", prefix_at(F.col("target"), F.col("j")).alias("prefix"), F.get("target", F.col("j")).alias("gold"))


@F.arrow_udf(ArrayType(IntegerType()))
def sums_before(lists: pa.Array) -> pa.Array:
    """For each number of a list the sum of those before it."""
    n, flat = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64), np.asarray(lists.flatten(), np.int64)
    ends, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(flat)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((sums[:-1] - np.repeat(sums[ends[:-1]], n)).astype(np.int32)))


def forced_rendered(steps: DataFrame) -> DataFrame:
    """`forced` with context and prefix rendered: ids joined by blanks. Each context and target is rendered once, before the
    rows are made; a prefix is then the first bytes of the rendered target, copied without a look at what they are."""
    whole = pairs(steps).select("conv_id", "step", rendered(context(F.col("x_t"), F.col("x_ref"))).alias("context"), unpadded(F.col("target")).alias("target"))
    sizes = F.transform("target", lambda x: F.octet_length(x.cast("string")) + 1)
    whole = whole.select("conv_id", "step", "context", rendered(F.col("target")).cast("binary").alias("whole"), F.arrays_zip("target", sums_before(sizes).alias("before")).alias("at"))
    rows = whole.select("conv_id", "step", "context", "whole", F.posexplode("at").alias("j", "at"))
    prefix = F.when(F.col("j") > 0, F.substring("whole", 1, F.col("at.before") - 1).cast("string"))
    return rows.select("conv_id", "step", "context", "j", prefix.alias("prefix"), F.col("at.target").alias("gold"))


def short_targets(steps: DataFrame, least: int = 2, keep_share: float = 0.0, keep: int | None = None, by: tuple[str, ...] = (), key: Column | None = None, order: Column | None = None, width: int = 1 << 52) -> DataFrame:
    """Steps with `least` target tokens or more, and of the shorter ones exactly `keep` a class (`by`), or the share
    `keep_share` of each class, rounded down, by `quota` (key, order, width)."""
    enough = F.size(unpadded(F.col("target"))) >= least
    if keep is None and keep_share <= 0:
        return steps.where(enough)
    short = steps.where(~enough)
    n = keep if keep is not None else short.groupBy(*by).agg(F.floor(F.count("*") * keep_share).alias("quota"))
    if not by:
        short, n = short.withColumn("_all", F.lit(0)), n if isinstance(n, int) else n.withColumn("_all", F.lit(0))
    kept = quota(short, n, *(by or ("_all",)), key=key, order=order, width=width)
    return steps.where(enough).unionByName(kept.select(*steps.columns))


def quota(rows: DataFrame, n: DataFrame | int, *by: str, key: Column, order: Column | None = None, width: int = 1 << 52) -> DataFrame:
    """Of each class (`by`) exactly n rows, or all if it has fewer: those with the smallest hash of the key, ties by the
    key, so the choice is repeatable. n: a number, or a table (by..., quota) in which classes that lack keep nothing.
    order: a whole number to choose by in place of the hash.

    Ranges of `width` of that number are counted first; whole ranges below the quota are kept, and only the range in
    which it is reached is ranked: a class of any size costs no window over it."""
    rows = rows.withColumns({"_order": F.xxhash64(key) if order is None else order, "_key": key}).withColumn("_range", F.floor(F.col("_order") / width).cast("long"))
    counts = rows.groupBy(*by, "_range").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    counts = counts.withColumn("quota", F.lit(n)) if isinstance(n, int) else counts.join(n, list(by))
    open_ = counts.where(F.col("_before") < F.col("quota")).select(*by, "_range", (F.col("quota") - F.col("_before")).alias("_left"), (F.col("_before") + F.col("count") <= F.col("quota")).alias("_whole"))
    met = rows.join(open_, [*by, "_range"])
    whole = met.where("_whole")
    cut = met.where("not _whole").withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_order", "_key"))).where("_rank <= _left").drop("_rank")
    return whole.unionByName(cut).drop("_order", "_key", "_range", "_left", "_whole")


def sample(rows: DataFrame, n: int, key: Column, by_chunk: bool) -> DataFrame:
    """n rows in the order of `key`: chunk by chunk (from the first chunks), or over all."""
    return rows.orderBy("chunk_no", key).limit(n) if by_chunk else rows.orderBy(key).limit(n)
