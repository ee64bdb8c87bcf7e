"""Exact-time windows: labels ahead, history behind, and features of the past."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridSpec


def complete(spec: GridSpec, first: int, last: int, aggregate: Column) -> Column:
    """An aggregate over slots `first` to `last`, null unless every slot is there with a value (keys are unique on the grid)."""
    window = spec.span(first, last)
    return F.when(F.count(spec.value).over(window) == last - first + 1, aggregate.over(window))


def targets(grid: DataFrame, spec: GridSpec) -> DataFrame:
    """`grid` with future and history counts, validity, the exact future total, and reasons where it is unknown."""
    ahead, behind = spec.span(1, spec.future), spec.span(1 - spec.history, 0)
    out = grid.withColumn("future_n", F.count(spec.value).over(ahead)).withColumn("history_n", F.count(spec.value).over(behind))
    out = out.withColumn("future_total", complete(spec, 1, spec.future, F.sum(F.col(spec.value).cast("decimal(28,2)"))).cast("decimal(38,2)"))
    out = out.withColumn("target_valid", F.col("future_n") == spec.future).withColumn("history_valid", F.col("history_n") == spec.history)
    why = [F.when(~F.col("target_valid"), "FUTURE_INCOMPLETE"), F.when(~F.col("history_valid"), "HISTORY_INCOMPLETE")]
    return out.withColumn("invalid_reason", F.array_compact(F.array(*why)))


def missing_offsets(grid: DataFrame, spec: GridSpec, first: int, last: int) -> Column:
    """Offsets in seconds, ascending, of the slots from `first` to `last` that are absent or null; frames of more than 64 slots are refused.

    The slots seen are bits of one number: slot k sets bit k modulo 64, and no two slots of a frame share one. Only a row whose number lacks a bit is spelled out.
    """
    if last - first >= 64:
        raise ValueError("a frame of missing offsets has 64 slots at most")
    turn = F.floor(F.col(spec.epoch) / spec.step)
    bit = F.when(F.col(spec.value).isNotNull(), F.expr(f"shiftleft(1L, CAST(pmod(floor({spec.epoch} / {spec.step}), 64) AS INT))"))
    frame = spec.span(first, last)
    seen, n = F.coalesce(F.bit_or(bit).over(frame), F.lit(0).cast("long")), F.count(spec.value).over(frame)
    absent = F.filter(F.sequence(F.lit(first), F.lit(last)), lambda k: F.getbit(seen, F.pmod(turn + k, F.lit(64)).cast("int")) == 0)
    spelled = F.transform(absent, lambda k: k.cast("long") * spec.step)
    return F.when(n == last - first + 1, F.array().cast("array<bigint>")).otherwise(spelled)


def lag_exact(spec: GridSpec, k: int) -> Column:
    """The value k slots back; null if that slot is absent."""
    return F.max(spec.value).over(spec.span(-k, -k))


def features(grid: DataFrame, spec: GridSpec) -> DataFrame:
    """Past-only features over the last 2 slots, the 2 before them, and the full history.

    Sums, maximum, deviation and wet slots are null unless their frame is whole. Changes compare with the exact slot or block
    before; the ratio of the short to the full sum is 0 where both are 0. A stretch is a row of slots without a gap that are all wet or all dry; the
    slot in which the current one began gives runs and recency: run_slots counts the wet slots up to now (run_censored: the run fills the history),
    since_event_s the seconds since the last wet slot, null with no_event where there is none (since_event_code is then the whole
    history). Nulls in a frame count as absent slots.
    """
    v = F.col(spec.value).cast("double")
    full = 1 - spec.history
    out = grid.withColumn("sum_2", complete(spec, -1, 0, F.sum(v))).withColumn("sum_all", complete(spec, full, 0, F.sum(v)))
    out = out.withColumn("sum_before_2", complete(spec, -3, -2, F.sum(v)))
    out = out.withColumn("max_all", complete(spec, full, 0, F.max(v))).withColumn("std_all", complete(spec, full, 0, F.stddev_pop(v)))
    out = out.withColumn("wet_all", complete(spec, full, 0, F.sum((v > 0).cast("long"))))
    out = out.withColumn("lag_1", lag_exact(spec, 1).cast("double")).withColumn("change_1", v - F.col("lag_1"))
    out = out.withColumn("change_2", F.col("sum_2") - F.col("sum_before_2"))
    out = out.withColumn("ratio", F.when(F.col("sum_all") == 0, 0.0).otherwise(F.col("sum_2") / F.col("sum_all")))
    at, order = F.col(spec.epoch), spec.window()
    wet = v > 0
    goes_on = (at - F.lag(spec.epoch).over(order) == spec.step) & (wet == F.lag(wet).over(order))
    began = F.last(F.when(~F.coalesce(goes_on, F.lit(False)), at), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    length = F.least(F.floor((at - began) / spec.step) + 1, F.lit(spec.history))
    out = out.withColumn("_stretch", F.when(F.count(spec.value).over(spec.span(full, 0)) == spec.history, length))
    run, dry = (F.when(F.col("_stretch").isNotNull(), F.when(c, F.col("_stretch")).otherwise(0)) for c in (wet, ~wet))
    since = F.when(dry < spec.history, dry * spec.step)
    out = out.withColumns({"run_slots": run.cast("long"), "since_event_s": since.cast("long"), "run_censored": (run == spec.history).cast("long")})
    out = out.withColumn("no_event", (dry == spec.history).cast("long"))
    return out.withColumn("since_event_code", F.when(F.col("no_event") == 1, spec.history * spec.step).otherwise(F.col("since_event_s")).cast("long")).drop("_stretch")


def over_buckets(grid: DataFrame, spec: GridSpec, slots: int, build: Callable[[DataFrame, GridSpec], DataFrame]) -> DataFrame:
    """What `build(grid, spec)` gives, with each series cut into buckets of `slots` slots, so that one long series is many groups.

    A row is copied into every bucket whose rows can see it, and copies are dropped after the windows. History and future
    must each be shorter than a bucket.
    """
    if max(spec.history, spec.future) >= slots:
        raise ValueError("a bucket must be longer than the history and the future")
    width, at = slots * spec.step, F.col(spec.epoch)
    seen_by = F.array_distinct(F.array(*[F.floor((at + shift) / width) for shift in (0, -spec.future * spec.step, (spec.history - 1) * spec.step)]))
    dealt = build(grid.withColumn("_bucket", F.explode(seen_by)), replace(spec, within=("_bucket",)))
    return dealt.where(F.col("_bucket") == F.floor(at / width)).drop("_bucket")


def edge_reasons(anchors: DataFrame, spec: GridSpec) -> DataFrame:
    """`anchors` of `targets` with edge_reason: DATASET_END or DATASET_START where the frame reaches past the epochs that any series has."""
    first, last = anchors.agg(F.min(spec.epoch), F.max(spec.epoch)).first()
    at = F.col(spec.epoch)
    why = [F.when(~F.col("target_valid") & (at + spec.future * spec.step > F.lit(last)), "DATASET_END"), F.when(~F.col("history_valid") & (at - (spec.history - 1) * spec.step < F.lit(first)), "DATASET_START")]
    return anchors.withColumn("edge_reason", F.array_compact(F.array(*why)))


def padded(grid: DataFrame, spec: GridSpec, start: int, stop: int, build: Callable[[DataFrame, GridSpec], DataFrame]) -> DataFrame:
    """`build` for the epochs from `start` to before `stop` alone: the scan is widened by what the windows see, and trimmed after them."""
    at = F.col(spec.epoch)
    wide = grid.where(at.between(start - (spec.history - 1) * spec.step, stop + spec.future * spec.step))
    return build(wide, spec).where((at >= start) & (at < stop))
