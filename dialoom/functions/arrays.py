"""Token-id sequences, step schedules and renderings as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special ids and schedule constants of the corpus format.
PAD, SOS, EOS, UNK = 0, 1, 2, 3
T0, DECAY, T_MIN, LR_DECAY, RATIO = 1.5, 0.95, 0.2, 0.95, 0.15


def with_end(ids: Column) -> Column:
    """Ids and the end mark; a null sentence gives []."""
    return F.when(ids.isNull(), F.array().cast("array<int>")).otherwise(F.concat(ids, F.array(F.lit(EOS))))


def padded(ids: Column, length: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def unpadded(ids: Column) -> Column:
    return F.filter(ids, lambda x: x != PAD)


def true_length(ids: Column) -> Column:
    return F.size(unpadded(ids))


def without_end(ids: Column) -> Column:
    """End marks become padding, as in supervised targets."""
    return F.transform(ids, lambda x: F.when(x == EOS, PAD).otherwise(x))


def first_label(ids: Column) -> Column:
    return F.coalesce(F.try_element_at(unpadded(ids), F.lit(1)), F.lit(PAD))


def has_target(ids: Column) -> Column:
    return F.coalesce(F.exists(ids, lambda x: x != PAD), F.lit(False))


def context(x_t: Column, x_ref: Column) -> Column:
    """The previous utterance, else the reference sentence, without padding; [SOS, EOS] where nothing is left."""
    base = F.when(x_t.isNull() | (F.size(x_t) == 0), x_ref).otherwise(x_t)
    return F.when(F.size(unpadded(base)) > 0, unpadded(base)).otherwise(F.array(F.lit(SOS), F.lit(EOS)))


def temperature(t: Column, t0: float = T0, decay: float = DECAY, floor: float = T_MIN) -> Column:
    return F.greatest(F.lit(t0) * F.pow(F.lit(decay), t), F.lit(floor))


def lr_factor(t: Column, decay: float = LR_DECAY) -> Column:
    return F.pow(F.lit(decay), t)


def control(t: Column, cap: Column, least: Column | int | None = None, extra: float = 0.0, budget: float = RATIO) -> Column:
    """The control values of step t (from 0) of a plan of `cap` steps, as (t_norm, remain_norm, min_done, budget): what share
    of the plan (and `extra` steps) is done and is left, whether `least` steps are done (1.0 where there is no least),
    and the share of steps that should speak. extra: 0 in evaluation."""
    whole = F.greatest(cap + extra, F.lit(1.0))
    done = F.lit(1.0) if least is None else F.when(t + 1 >= least, 1.0).otherwise(0.0)
    return F.struct(((t + 1) / whole).alias("t_norm"), (F.greatest(whole - (t + 1), F.lit(0.0)) / whole).alias("remain_norm"), done.alias("min_done"), F.lit(budget).alias("budget"))


def gate_threshold(t: Column, start: float, eps: float, cap: Column) -> Column:
    """start - eps (t + 1) / cap, kept in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(start) - F.lit(eps) * (t + 1) / cap))


def guarded_gate(logit: Column, temp: Column | float = 1.0) -> Column:
    """Sigmoid of a logit over a temperature; NaN counts as 0, infinities as 10 in size."""
    x = F.when(F.isnan(logit), 0.0).when(logit == float("inf"), 10.0).when(logit == float("-inf"), -10.0).otherwise(logit)
    p = 1 / (1 + F.exp(-x / (F.lit(temp) if isinstance(temp, float) else temp)))
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def entropy(p: Column) -> Column:
    return -(p * F.log(p) + (1 - p) * F.log(1 - p))


def top_k(values: Column, k: int) -> Column:
    """The k largest as (p, id), ties to the smaller id."""
    ranked = F.sort_array(F.transform(values, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s["i"]).alias("id"), s["p"].alias("p")))


def arg_max(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded as C's printf does: the exact value counts, and halves go to the even digit
    (format_string rounds them up)."""
    x = value.cast("double")
    plain = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(plain, F.call_function("format_number", x, F.lit("0." + "0" * places))).otherwise(F.format_string(f"%.{places}f", x))


def rendered_top(top: Column) -> Column:
    """Pairs (word, p) as `word:0.123456`, joined by blanks."""
    return F.array_join(F.transform(top, lambda x: F.concat(x["word"], F.lit(":"), fixed(x["p"], 6))), " ")


def rendered(ids: Column) -> Column:
    """Ids joined by blanks; null stays null."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
