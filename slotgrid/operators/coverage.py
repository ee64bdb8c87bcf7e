"""Calendar spines, coverage panels and comparisons that need support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .separation import distance_km, widest_separation  # noqa: F401


def month_cells(df: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """(entity, year, month): days present, total, days expected by the calendar, coverage."""
    month = F.trunc(day, "month")
    cells = df.groupBy(F.col(entity).alias("entity"), month.alias("month_start")).agg(F.count_distinct(day).alias("days"), F.sum(value).alias("total"))
    return cells.select("entity", F.year("month_start").alias("year"), F.month("month_start").alias("month"), "days", "total", F.dayofmonth(F.last_day("month_start")).alias("expected")).withColumn("coverage", F.col("days") / F.col("expected"))


def spine(cells: DataFrame) -> DataFrame:
    """Every entity with every month from the first to the last one seen, absent cells with zero days; two dates pass through the driver."""
    first, last = cells.agg(F.min(F.make_date("year", "month", F.lit(1))), F.max(F.make_date("year", "month", F.lit(1)))).first()
    if first is None:
        return cells.select("entity", "year", "month", "days")
    start = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 MONTH")))
    frame = cells.select("entity").distinct().select("entity", start.alias("start")).select("entity", F.year("start").alias("year"), F.month("start").alias("month"))
    return frame.join(cells, ["entity", "year", "month"], "left").select("entity", "year", "month", F.coalesce("days", F.lit(0)).alias("days"))


def panel(cells: DataFrame, cutoff: float, years: list[int]) -> DataFrame:
    """(month, entity): entities that reach the cutoff in that month of every year."""
    good = cells.where(F.col("year").isin(years) & (F.col("coverage") >= cutoff))
    return good.groupBy("month", "entity").agg(F.count_distinct("year").alias("n")).where(F.col("n") == len(years)).select("month", "entity")


def all_months(cells: DataFrame, cutoffs: list[float], years: list[int]) -> DataFrame:
    """(cutoff, entity): entities that reach the cutoff in every month of every one of `years`; one pass serves all cutoffs."""
    counts = [F.count_if(F.col("coverage") >= c).alias(f"_{i}") for i, c in enumerate(cutoffs)]
    held = cells.where(F.col("year").isin(years)).groupBy("entity").agg(*counts)
    each = F.explode(F.array(*[F.when(F.col(f"_{i}") == 12 * len(years), F.lit(c)) for i, c in enumerate(cutoffs)])).alias("cutoff")
    return held.select(each, "entity").where("cutoff IS NOT NULL")


def panel_means(cells: DataFrame, fixed: DataFrame, years: list[int]) -> DataFrame:
    """(year, month): entities of the panel and their mean daily total, each with equal weight."""
    rows = cells.where(F.col("year").isin(years)).join(fixed, ["month", "entity"], "left_semi")
    return rows.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("total") / F.col("days")).alias("mean"))


def adjacent_years(cells: DataFrame, cutoff: float) -> DataFrame:
    """(entity, month, year, before, after): daily means of the entities that reach the cutoff in a month of one year and of the next; one window, no self join."""
    good = cells.where(F.col("coverage") >= cutoff).select("entity", "year", "month", (F.col("total") / F.col("days")).alias("before"))
    following = Window.partitionBy("entity", "month").orderBy("year").rangeBetween(1, 1)
    return good.withColumn("after", F.max("before").over(following)).where("after IS NOT NULL")


def paired_years(cells: DataFrame, cutoff: float) -> DataFrame:
    """(year, month): change to the next year over entities that reach the cutoff in both."""
    return adjacent_years(cells, cutoff).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("after") - F.col("before")).alias("delta"))


def paired_support(cells: DataFrame, cutoff: float) -> DataFrame:
    """(year, month) of every pair of years with cells: both means over the common entities, their difference, and SUPPORTED or NO_COMMON."""
    pairs = cells.select("year", "month").distinct()
    pairs = pairs.join(pairs.select((F.col("year") - 1).alias("year"), "month"), ["year", "month"])
    found = adjacent_years(cells, cutoff).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after"))
    out = pairs.join(found, ["year", "month"], "left")
    return out.select("year", "month", F.coalesce("n", F.lit(0)).alias("n"), "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.when(F.col("n") > 0, "SUPPORTED").otherwise("NO_COMMON").alias("status"))


def slot_coverage(df: DataFrame, entity: str, epoch: str, step: int) -> DataFrame:
    """(entity, month_start): stamps, occupied slots, phases, stamps off the grid, slots hit twice, slots the calendar expects and those between first and last."""
    at = F.col(epoch)
    month = F.trunc(F.to_date(F.timestamp_seconds(at)), "month")
    stamps = df.where(at.isNotNull()).groupBy(F.col(entity).alias("entity"), month.alias("month_start"), at.alias("at")).agg(F.count(F.lit(1)).alias("k"))
    out = stamps.groupBy("entity", "month_start").agg(
        F.sum("k").alias("n"), F.count(F.lit(1)).alias("stamps"), F.count_distinct(F.floor(F.col("at") / step)).alias("occupied"), F.count_distinct(F.pmod("at", F.lit(step))).alias("phases"),
        F.sum((F.pmod("at", F.lit(step)) != 0).cast("long")).alias("off_grid"), F.min("at").alias("first"), F.max("at").alias("last"),
    )
    days = F.dayofmonth(F.last_day("month_start"))
    return out.withColumns({"slot_collisions": F.col("stamps") - F.col("occupied"), "expected": (days * (86_400 // step)).cast("long"), "span_slots": F.floor(F.col("last") / step) - F.floor(F.col("first") / step) + 1})


def hour_panel(df: DataFrame, entity: str, epoch: str, value: str, hours: int, days: int) -> DataFrame:
    """(hour): mean over entities of their hourly means, for the entities that have all `hours` hours, each on at least `days` days; entities weigh the same."""
    at = F.timestamp_seconds(epoch)
    cells = df.groupBy(F.col(entity).alias("entity"), F.hour(at).alias("hour")).agg(F.count_distinct(F.to_date(at)).alias("days"), F.avg(value).alias("mean"))
    whole = cells.where(F.col("days") >= days).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == hours)
    return cells.join(whole.select("entity"), "entity", "left_semi").groupBy("hour").agg(F.count(F.lit(1)).alias("entities"), F.avg("mean").alias("mean"))


def annual(cells: DataFrame, years: list[int], cutoff: float) -> DataFrame:
    """(year): entities, the mean total of all, and of those that reach the cutoff in every month of every one of `years`."""
    rows = cells.where(F.col("year").isin(years))
    good = F.count(F.when(F.col("coverage") >= cutoff, 1)) == 12 * len(years)
    fixed = rows.groupBy("entity").agg(good.alias("fixed"))
    totals = rows.groupBy("entity", "year").agg(F.sum("total").alias("total"), F.sum("days").alias("days"), F.count(F.lit(1)).alias("months")).join(fixed, "entity")
    return totals.groupBy("year").agg(F.count(F.lit(1)).alias("entities"), F.avg("total").alias("mean_total"), F.sum(F.col("fixed").cast("long")).alias("fixed_entities"), F.avg(F.when(F.col("fixed"), F.col("total"))).alias("fixed_mean"))


def mean_of_means(df: DataFrame, outer: list[str], inner: list[str], values: list[str]) -> DataFrame:
    """Per `outer`: the mean over the inner groups of each value's mean, and how many inner groups have one; unknown stays unknown, never zero."""
    first = df.groupBy(*outer, *inner).agg(*[F.avg(v).alias(v) for v in values])
    return first.groupBy(*outer).agg(*[F.avg(v).alias(v) for v in values], *[F.count(v).alias(f"n_{v}") for v in values])


def extremes(means: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Per `by`: the least and greatest `value` and the `order` cell that has it; ties go to the smaller cell, nulls take no part."""
    known = means.where(F.col(value).isNotNull())
    low, high = F.struct(F.col(value).alias("v"), F.col(order).alias("o")), F.struct((-F.col(value)).alias("v"), F.col(order).alias("o"))
    out = known.groupBy(*by).agg(F.min(low).alias("low"), F.min(high).alias("high"))
    return out.select(*by, F.col("low.o").alias(f"low_{order}"), F.col("low.v").alias("low"), F.col("high.o").alias(f"high_{order}"), (-F.col("high.v")).alias("high"))


def period_gaps(cells: DataFrame) -> DataFrame:
    """(entity, year, next_year, gap_months): months from an entity's last cell of a year to its first of the next year it has; the last year has no row."""
    years = cells.groupBy("entity", "year").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    order = Window.partitionBy("entity").orderBy("year")
    out = years.withColumns({"next_year": F.lead("year").over(order), "next_first": F.lead("first").over(order)}).where("next_year IS NOT NULL")
    return out.withColumn("gap_months", (F.col("next_year") - F.col("year")) * 12 + F.col("next_first") - F.col("last"))


def gap_classes(df: DataFrame, entity: str, epoch: str, step: int) -> DataFrame:
    """(kind, n, longest) of the gaps to the row before: one step, shorter, longer, or no multiple of the step."""
    gap = F.col(epoch) - F.lag(epoch).over(Window.partitionBy(entity).orderBy(epoch))
    kind = F.when(F.col("gap") == step, "STEP").when(F.col("gap") < step, "SHORTER").when(F.col("gap") % step != 0, "OFF_STEP").otherwise("LONGER")
    return df.select(gap.alias("gap")).where("gap IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("longest"))


def phase_transitions(df: DataFrame, entity: str, epoch: str, phase: str, depth: int = 4) -> DataFrame:
    """Rows whose phase differs from the row before: that phase (p1), the gap, and whether the `depth` rows before agreed; the first `depth` rows of a series have none."""
    order = Window.partitionBy(entity).orderBy(epoch)
    lags = {f"p{k}": F.lag(phase, k).over(order) for k in range(1, depth + 1)}
    out = df.withColumns({**lags, "gap": F.col(epoch) - F.lag(epoch).over(order)}).where(F.col(f"p{depth}").isNotNull() & (F.col(phase) != F.col("p1")))
    steady = F.lit(True)
    for k in range(2, depth + 1):
        steady = steady & (F.col(f"p{k}") == F.col("p1"))
    return out.select(entity, epoch, phase, "p1", "gap", steady.cast("long").alias("steady_before"))
