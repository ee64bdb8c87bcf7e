"""Empirical distributions as tables, survival by as-of lookup, shrinkage, and evaluation of the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def fit(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, cum_n, n): sorted distinct values with the rows at or below each, and the group's rows."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy(group).orderBy(value)
    return counted.select(group, value, F.sum("k").over(order).alias("cum_n"), F.sum("k").over(Window.partitionBy(group)).alias("n"))


def running(df: DataFrame, order: list[str], amount: str) -> DataFrame:
    """`df` with `running`, the sum of `amount` up to each row in `order`, over all rows.

    The rows are ranged over partitions and written once with the number of their range, so that every later reading sees the same ranges;
    each range is summed apart, and a window over the few totals gives each its start. No task gets every row, and rows
    equal in `order` lie in one range and share a sum.
    """
    ranged = Scratch(df.sparkSession, "ranges").keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_all"))
    starts = totals.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_start"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order)), F.lit(0))
    out = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range")  # one row a range
    return out.withColumn("running", F.col("_inside") + F.col("_start")).drop("_range", "_inside", "_start")


def fit_all(df: DataFrame, value: str) -> DataFrame:
    """(value, cum_n) over all rows, nulls left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    return running(counted, [value], "k").select(value, F.col("running").alias("cum_n"))


def as_of(cdf: DataFrame, asked: DataFrame, group: str, value: str, level: str) -> DataFrame:
    """(group, level, n, above) for the rows (group, level) of `asked`: one sort per group finds for each level the last value not above it; groups without values have none."""
    exact = "decimal(38,18)"
    known = cdf.select(group, F.col(value).cast(exact).alias("_v"), "cum_n", "n", F.lit(0).alias("_f"))
    wanted = asked.select(group, F.col(level).cast(exact).alias("_v"), F.lit(None).cast("long").alias("cum_n"), F.lit(None).cast("long").alias("n"), F.lit(1).alias("_f"))
    below = F.coalesce(F.last("cum_n", ignorenulls=True).over(Window.partitionBy(group).orderBy("_v", "_f")), F.lit(0))
    out = known.unionByName(wanted).withColumns({"_below": below, "_n": F.max("n").over(Window.partitionBy(group))})
    return out.where((F.col("_f") == 1) & F.col("_n").isNotNull()).select(group, F.col("_v").alias(level), F.col("_n").alias("n"), (F.col("_n") - F.col("_below")).alias("above"))


def as_of_all(cdf: DataFrame, levels: DataFrame, group: str, value: str, level: str) -> DataFrame:
    """(level, share): the share of all values above each level."""
    exact = "decimal(38,18)"
    own = F.col("cum_n") - F.coalesce(F.lag("cum_n").over(Window.partitionBy(group).orderBy(value)), F.lit(0))
    counts = cdf.select(F.col(value).cast(exact).alias("_v"), own.alias("k")).groupBy("_v").agg(F.sum("k").alias("k")).withColumn("_f", F.lit(0))
    both = counts.unionByName(levels.select(F.col(level).cast(exact).alias("_v"), F.lit(0).cast("long").alias("k"), F.lit(1).alias("_f")))
    whole = counts.agg(F.sum("k")).first()[0] or 0
    found = running(both, ["_v", "_f"], "k").where("_f = 1")
    return found.select(F.col("_v").alias(level), (F.lit(1.0) - F.col("running") / F.lit(whole)).alias("share"))


def check(cdf: DataFrame, group: str, value: str, rows: DataFrame) -> DataFrame:
    """One row: counts that do not rise with the value, groups whose last count is not n, and the rows of all groups beside those of `rows`."""
    order = Window.partitionBy(group).orderBy(value)
    seen = cdf.withColumn("_b", F.lag("cum_n").over(order))
    per = seen.groupBy(group).agg(F.sum((F.col("_b") >= F.col("cum_n")).cast("long")).alias("a"), F.max("cum_n").alias("m"), F.max("n").alias("n"), F.sum((F.lit(1)).cast("long")).alias("k"))
    found = per.agg(F.sum("a").alias("not_rising"), F.sum(F.when(F.col("m") != F.col("n"), F.col("k")).otherwise(0)).alias("wrong_last"), F.sum("n").alias("group_rows")).withColumn("all_rows", F.lit(None).cast("long"))
    whole = rows.agg(F.count(F.lit(1)).alias("all_rows")).select(*[F.lit(None).cast("long").alias(c) for c in found.columns[:3]], "all_rows")
    both = found.unionByName(whole)
    return both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in both.columns])


def frequency(expanded: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, above, p): the share of exceedances; null labels take no part."""
    out = expanded.where("label IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("above"))
    return out.withColumn("p", F.col("above") / F.col("n"))


def score(asked: DataFrame, found: DataFrame, overall: DataFrame, keys: list[str], levels: list[str], prior: str, limit: int = 1_000_000) -> DataFrame:
    """`asked` with p = (above + prior * share) / (n + prior) from `found` (keys, n, above); an unseen group gets the share of `overall` (levels, share).

    The table of the overall shares has a row per level of the request; the groups are broadcast only up to `limit` rows.
    """
    small = found.limit(limit + 1).count() <= limit
    groups = found.select(*keys, "n", "above")
    out = asked.join(F.broadcast(groups) if small else groups, keys, "left").join(F.broadcast(overall), levels, "left")
    p = F.coalesce((F.col("above") + F.col(prior) * F.col("share")) / (F.col("n") + F.col(prior)), F.col("share"))
    return out.withColumn("p", p).drop("n", "above", "share")


def validity(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows, unknown and NaN scores, scores outside 0 to 1, null labels, and the range of the scores."""
    p = F.col("p")

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    bad = p.isNull() | F.isnan(p)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count(bad).alias("unknown_p"), count(~bad & ((p < 0) | (p > 1))).alias("outside"), count(F.col("label").isNull()).alias("null_labels"), F.min("p").alias("least"), F.max("p").alias("most"))


def survival(cdf: DataFrame, group: str, value: str, thresholds: list[str]) -> DataFrame:
    """(group, threshold, n, above): rows strictly above each threshold; one aggregate over the distinct values serves all."""
    levels = cdf.withColumn("threshold", F.explode(F.array(*[F.lit(t).cast("decimal(38,18)") for t in thresholds])))
    below = F.max(F.when(F.col(value).cast("decimal(38,18)") <= F.col("threshold"), F.col("cum_n")))
    out = levels.groupBy(group, "threshold").agg(F.max("n").alias("n"), (F.max("n") - F.coalesce(below, F.lit(0))).alias("above"))
    return out.withColumn("threshold", F.col("threshold").cast("double"))


def shrink(groups: DataFrame, overall: DataFrame, prior: float) -> DataFrame:
    """`groups` (…, threshold, n, above) with p = (above + prior * overall share) / (n + prior)."""
    share = overall.select("threshold", (F.col("above") / F.col("n")).alias("share"))
    # one row per threshold of the request
    return groups.join(F.broadcast(share), "threshold").withColumn("p", (F.col("above") + prior * F.col("share")) / (F.col("n") + prior))


def metrics(scores: DataFrame, by: list[str], clip: float = 1e-6) -> DataFrame:
    """Per group: rows, base rate, mean p, Brier score and clipped log loss."""
    p = F.least(F.greatest("p", F.lit(clip)), F.lit(1 - clip))
    loss = -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("base_rate"), F.avg("p").alias("mean_p"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), F.avg(loss).alias("log_loss"))


def calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Per threshold and equal-width bin: rows, mean p, observed rate; the last bin is closed on the right."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy("threshold", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("observed"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Per threshold: the row-weighted mean gap between mean p and observed rate."""
    return bins.groupBy("threshold").agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("n")).alias("ece"))


def areas(scores: DataFrame, by: list[str], bins: int = 1000) -> DataFrame:
    """Per group: areas under the ROC and precision-recall curves by trapezoids over descending score bins; null where one class is absent.

    The precision-recall curve starts at precision 1 and recall 0.
    """
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    counted = scores.groupBy(*by, place.alias("bin")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    down = Window.partitionBy(*by).orderBy(F.desc("bin"))
    whole = Window.partitionBy(*by)
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    curve = counted.withColumns({"tp": tp, "fp": fp, "p_all": F.sum("pos").over(whole), "n_all": F.sum("neg").over(whole)})
    curve = curve.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    before = F.coalesce(F.lag("precision").over(down), F.lit(1.0))
    curve = curve.withColumn("pr", F.when(F.col("p_all") > 0, F.col("pos") / F.col("p_all") * (F.col("precision") + before) / 2))
    curve = curve.withColumn("roc", F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    both = (F.max("p_all") > 0) & (F.max("n_all") > 0)
    return curve.groupBy(*by).agg(F.when(both, F.sum("roc") / (F.max("p_all") * F.max("n_all"))).alias("roc_area"), F.when(both, F.sum("pr")).alias("pr_area"))


def grouped(scores: DataFrame, labels: dict[str, Column], by: list[str], bins: int = 10) -> DataFrame:
    """Per named group, level and `by`: rows, Brier score, calibration error, areas, and the share of all rows that the group holds.

    `labels` are text columns; a null label puts a row in no group. Calibration and rank bins come from one table.
    """
    each = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("grouping"), c.alias("level"))) for n, c in labels.items()]))
    rows = scores.withColumn("_g", F.explode(each)).select("*", "_g.*").drop("_g")
    keys = ["grouping", "level", *by]
    per_bin = rows.groupBy(*keys, F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("label").alias("sl"), F.sum((F.col("p") - F.col("label")) ** 2).alias("sq"))
    out = per_bin.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sl"))) / F.sum("n")).alias("ece"))
    out = out.join(areas(rows, keys), keys)
    return out.withColumn("coverage", F.col("n") / F.sum("n").over(Window.partitionBy("grouping", *by)))


def low_region(scores: DataFrame, by: list[str], limit: float = 0.05) -> DataFrame:
    """Per group: rows with p up to `limit`, their mean p and observed rate; groups without such rows are absent."""
    return scores.where(F.col("p") <= limit).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("observed"))


def select_model(table: DataFrame, order: list[str], tolerance: float = 1e-5) -> DataFrame:
    """(model, mean_brier, place, chosen): thresholds weigh the same within a fold and folds the same; of the models within `tolerance` of the best the one first in `order` is chosen."""
    per_fold = table.groupBy("model", "protocol").agg(F.avg("brier").alias("b"))
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model")).cast("int")
    means = per_fold.groupBy("model").agg(F.avg("b").alias("mean_brier")).withColumn("place", place)
    whole = Window.partitionBy(F.lit(1))  # one row a model
    near = means.withColumn("_n", F.col("mean_brier") <= F.min("mean_brier").over(whole) + tolerance)
    first = F.min(F.when(F.col("_n"), F.col("place"))).over(whole)
    return near.select("model", "mean_brier", "place", (F.col("place") == first).cast("long").alias("chosen"))


def ablation(means: DataFrame, place: str = "place", value: str = "mean_brier") -> DataFrame:
    """`means` with delta to the step before in a fixed sequence of a few models; null for the first."""
    return means.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(F.lit(1)).orderBy(place)))


def skill(table: DataFrame, baseline: str, by: list[str]) -> DataFrame:
    """`table` with skill = 1 - brier / brier of the baseline in the same `by`; null where that is zero."""
    base = F.max(F.when(F.col("model") == baseline, F.col("brier"))).over(Window.partitionBy(*by))
    return table.withColumn("skill", F.when(base > 0, 1 - F.col("brier") / base))


def reconcile_bins(scores: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Per group: rows, positives and mean p rebuilt from the calibration bins, and their difference from the totals themselves."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    each = scores.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("observed"))
    rebuilt = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("observed")).alias("positives"), (F.sum(F.col("n") * F.col("mean_p")) / F.sum("n")).alias("mean_p"))
    totals = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("t_n"), F.sum("label").alias("t_pos"), F.avg("p").alias("t_p"))
    return rebuilt.join(totals, by).select(*by, "n", "positives", "mean_p", (F.col("n") - F.col("t_n")).alias("n_gap"), F.abs(F.col("positives") - F.col("t_pos")).alias("positives_gap"), F.abs(F.col("mean_p") - F.col("t_p")).alias("mean_p_gap"))
