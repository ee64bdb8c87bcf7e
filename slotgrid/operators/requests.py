"""Requests for a probability: grouping keys, checks of thresholds, and answers from the past alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import GridSpec
from .ecdf import as_of, as_of_all
from .records import decimal_shape


def local_calendar(epoch: Column, zone_seconds: int) -> tuple[Column, Column]:
    """Month and hour of an epoch in a fixed zone so many seconds ahead of the session's."""
    at = F.timestamp_seconds(epoch + zone_seconds)
    return F.month(at), F.hour(at)


def amount_bin(amount: Column, cuts: list[float], wet: float) -> Column:
    """`B<k>|wet` or `|dry`: k counts the cuts below the amount, an amount equal to a cut stays under it; null for a null amount."""
    k = F.lit(0)
    for c in cuts:
        k = k + (amount > c).cast("int")
    return F.when(amount.isNotNull(), F.concat(F.lit("B"), k.cast("string"), F.lit("|"), F.when(amount > wet, "wet").otherwise("dry")))


def group_keys(df: DataFrame, entity: str, epoch: str, amount: str, *, zone_seconds: int, cuts: list[float], wet: float) -> DataFrame:
    """`df` with climate (entity, month, hour) and recent (amount bin and wet flag)."""
    month, hour = local_calendar(F.col(epoch), zone_seconds)
    return df.withColumns({"climate": F.concat_ws("|", F.col(entity).cast("string"), month.cast("string"), hour.cast("string")), "recent": amount_bin(F.col(amount), cuts, wet)})


def threshold_problem(text: Column) -> Column:
    """Why a threshold text cannot be used: NOT_A_NUMBER (null, blank, NaN, infinite or a truth value too), NEGATIVE, BAD_EXPONENT where an int does not hold it, TOO_LARGE from 1e20 on, TOO_MANY_DECIMALS beyond 18; else null."""
    shape = decimal_shape(text)
    return (
        F.when(shape["fits"].isNull(), "NOT_A_NUMBER")
        .when(F.regexp_like(text, F.lit(r"^\s*-")) & (text.try_cast("double") != 0), "NEGATIVE")
        .when(shape["exponent"].isNull(), "BAD_EXPONENT")
        .when(shape["integer_digits"] > 20, "TOO_LARGE")
        .when(shape["scale"] > 18, "TOO_MANY_DECIMALS")
    )


def answer(asked: DataFrame, anchors: DataFrame, cdf: DataFrame, spec: GridSpec, prior: float, group: str = "entity") -> DataFrame:
    """`asked` (entity, epoch, threshold text) with reject_reason and p, the shrunken share of totals above the threshold.

    A request is refused for its threshold, an entity without anchors, an epoch off the grid, or a history that is not
    whole; the first that applies is named. Thresholds are compared as decimals. `cdf` is (grp, value, cum_n, n) by the column `group` of the
    anchors, where an anchor without a group gets the overall share. Each distinct threshold is looked up once per group, and overall.
    """
    level = F.col("threshold").try_cast("decimal(38,18)")
    known = anchors.select("entity").distinct().withColumn("_known", F.lit(1))
    at = anchors.select("entity", F.col(spec.epoch).alias("epoch"), "history_n", F.col(group).alias("_group"))
    out = asked.join(known, "entity", "left").join(at, ["entity", "epoch"], "left")
    reason = (
        F.when(threshold_problem(F.col("threshold")).isNotNull() | level.isNull(), "BAD_THRESHOLD")
        .when(F.col("_known").isNull(), "UNKNOWN_ENTITY")
        .when(F.col("epoch") % spec.step != 0, "OFF_GRID")
        .when(F.coalesce("history_n", F.lit(0)) < spec.history, "INCOMPLETE_HISTORY")
    )
    out = out.withColumn("reject_reason", reason).withColumn("_level", F.when(F.col("reject_reason").isNull(), level))
    pairs = out.where("_level IS NOT NULL").select(F.col("_group").alias("grp"), "_level").distinct()
    own = as_of(cdf, pairs, "grp", "value", "_level").select(F.col("grp").alias("_group"), "_level", F.col("n").alias("_n"), F.col("above").alias("_above"))
    overall = as_of_all(cdf, pairs.select("_level").distinct(), "grp", "value", "_level").withColumnRenamed("share", "_share")
    scored = out.join(own, ["_group", "_level"], "left").join(overall, "_level", "left")
    p = F.coalesce((F.col("_above") + prior * F.col("_share")) / (F.col("_n") + prior), F.col("_share"))
    return scored.select(*[c for c in asked.columns], "reject_reason", F.when(F.col("reject_reason").isNull(), p).alias("p"))
