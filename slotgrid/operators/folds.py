"""Threshold labels, nested samples, purged folds, support and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the sampling key: two primes spread the first keys, a third is the number of classes.
FACTORS, CLASSES = (7_919, 104_729, 1_299_709, 15_485_863), 10_007


def in_sample(keys: dict[str, int], share: int, seed: int = 7) -> Column:
    """Whether a row is in the first `share` of 10,007 classes of its whole-number keys, each divided by its step.

    Only the keys decide, so the order of rows does not matter and a smaller share is a subset of a larger one; a null key is never in.
    """
    total = F.lit(seed).cast("long")
    for factor, (name, step) in zip(FACTORS, keys.items(), strict=False):
        total = total + F.floor(F.col(name) / step) * factor
    return F.coalesce(F.pmod(total, F.lit(CLASSES)) < share, F.lit(False))


def sample(df: DataFrame, keys: dict[str, int], share: int, seed: int = 7) -> DataFrame:
    """Nested sample by `in_sample`."""
    return df.where(in_sample(keys, share, seed))


def expand(df: DataFrame, total: str, thresholds: list[str]) -> DataFrame:
    """Each row once per threshold with a strict exceedance label; an unknown total has a null label. Thresholds are texts, never doubles."""
    levels = F.array(*[F.lit(t).cast("decimal(38,18)") for t in thresholds])
    out = df.withColumn("threshold", F.explode(levels))
    return out.withColumn("label", (F.col(total).cast("decimal(38,18)") > F.col("threshold")).cast("double")).withColumn("threshold", F.col("threshold").cast("double"))


def audit_expansion(anchors: DataFrame, expanded: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """One row: anchors, rows, whether there are `levels` rows an anchor, keys that repeat, and null labels."""
    n = anchors.agg(F.count(F.lit(1)).alias("anchors"))
    groups = expanded.groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").isNull().cast("long")).alias("m"))
    found = groups.agg(F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("long")).alias("repeated_keys"), F.sum("m").alias("null_labels"))
    sides = n.select("anchors", *[F.lit(None).cast("long").alias(c) for c in found.columns]).unionByName(found.withColumn("anchors", F.lit(None).cast("long")))
    out = sides.agg(*[F.max(c).alias(c) for c in sides.columns])
    return out.withColumn("whole", (F.col("rows") == F.col("anchors") * levels).cast("long"))


def fold_role(epoch: Column, label_end: Column, train_end: int, eval_end: int) -> Column:
    """TRAIN before `train_end`, VALIDATION before `eval_end`, EXCLUDED_BOUNDARY where the label reaches its block's end, UNUSED after."""
    inside = F.when(epoch < train_end, F.when(label_end >= train_end, "EXCLUDED_BOUNDARY").otherwise("TRAIN"))
    return inside.when(epoch < eval_end, F.when(label_end >= eval_end, "EXCLUDED_BOUNDARY").otherwise("VALIDATION")).otherwise("UNUSED")


def roles(anchors: DataFrame, epoch: str, ahead: int, folds: list[tuple[str, int, int]]) -> DataFrame:
    """`anchors` once per fold (name, train_end, eval_end), with protocol and role; `ahead` seconds are what a label looks forward."""
    at = F.col(epoch)
    each = [F.struct(F.lit(n).alias("protocol"), fold_role(at, at + ahead, a, b).alias("role")) for n, a, b in folds]
    return anchors.withColumn("_fold", F.explode(F.array(*each))).select("*", "_fold.protocol", "_fold.role").drop("_fold")


def supported(df: DataFrame, entity: str, least: int) -> DataFrame:
    """Rows of the entities with at least `least` rows."""
    enough = df.groupBy(entity).count().where(F.col("count") >= least).select(entity)
    return df.join(enough, entity, "left_semi")


def training_anchors(anchors: DataFrame, entity: str, least: int) -> DataFrame:
    """Eligible anchors of role TRAIN whose entity has at least `least` of them."""
    return supported(anchors.where("role = 'TRAIN' AND target_valid AND history_valid"), entity, least)


def kept_thresholds(expanded: DataFrame, least: int) -> DataFrame:
    """(threshold, positives, negatives) of the thresholds with at least `least` of each; null labels count for neither."""
    out = expanded.groupBy("threshold").agg(F.sum("label").cast("long").alias("positives"), F.sum(1 - F.col("label")).cast("long").alias("negatives"))
    return out.where((F.col("positives") >= least) & (F.col("negatives") >= least))


def _long(df: DataFrame, name: str, counts: dict[str, str]) -> DataFrame:
    return df.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias(name), F.col(c).alias("n")) for k, c in counts.items()])).alias("_c")).select(F.col(f"_c.{name}"), F.col("_c.n"), *df.columns)


def flow(anchors: DataFrame, entity: str, least: int) -> DataFrame:
    """(stage, n): anchors observed, with whole history, eligible, and used for training; the entity's support is a window over its own rows."""
    eligible = F.col("history_valid") & F.col("target_valid")
    trains = eligible & (F.col("role") == "TRAIN")
    with_support = anchors.withColumn("_k", F.sum(trains.cast("long")).over(Window.partitionBy(entity)))
    steps = {"OBSERVED": F.lit(True), "HISTORY_VALID": F.col("history_valid"), "ELIGIBLE": eligible, "USED": trains & (F.col("_k") >= least)}
    row = with_support.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in steps.items()])
    return _long(row, "stage", {k: k for k in steps}).select("stage", "n")


def losses(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(loss, n, of_n, percent): rows each kind costs, from one pass; percent is null for an empty table."""
    row = df.agg(F.count(F.lit(1)).alias("of_n"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in kinds.items()])
    out = _long(row, "loss", {k: k for k in kinds})
    return out.select("loss", "n", "of_n", F.when(F.col("of_n") > 0, 100 * F.col("n") / F.col("of_n")).alias("percent"))


def retention(df: DataFrame, period: Column, kept: Column) -> DataFrame:
    """Per period: rows, those kept and not, and their share; a null flag is not kept."""
    flag = F.coalesce(kept, F.lit(False)).cast("long")
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("anchors"), F.sum(flag).alias("complete"), F.sum(1 - flag).alias("incomplete"), F.avg(flag).alias("rate"))


def first_cases(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows in `order` of each group, with their place from 1; ties in `order` are settled arbitrarily, so give a key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def probes(df: DataFrame, entity: str, epoch: str, chosen: Callable[[], Column]) -> DataFrame:
    """First and last row of each series and the rows `chosen()` picks, with `kind` FIRST, LAST or SAMPLE."""
    series = Window.partitionBy(entity)
    at = F.col(epoch)
    kind = F.when(at == F.min(epoch).over(series), "FIRST").when(at == F.max(epoch).over(series), "LAST").when(chosen(), "SAMPLE")
    return df.withColumn("kind", kind).where("kind IS NOT NULL")
