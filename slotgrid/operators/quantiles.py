"""Quantiles per group at scale: sketches that merge over periods, and exact values by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch

#: Size of a sketch; its ranks are off by about 1.3 hundredths at 200 and by a tenth of that at 2,000.
SKETCH = 2_000
#: Distinct values of a bracket from which it is settled by sorting, and the cells that a larger one is cut into.
FEW, CELLS = 4_096, 64
#: Rounds after which a bracket that does not shrink is an error; each round leaves about one cell of `CELLS`.
MOST_ROUNDS = 40
#: Brackets (one or two per group and quantile) up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def sketches(df: DataFrame, by: list[str], value: str, k: int = SKETCH) -> DataFrame:
    """(by, sketch, n): one sketch per group of the values that are no null or NaN; tasks hold a sketch a group, never its values."""
    known = F.col(value).cast("double")
    rows = df.select(*by, known.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(stored: DataFrame, by: list[str], k: int = SKETCH) -> DataFrame:
    """(by, sketch, n) of coarser groups from stored sketches alone; the rows behind them are not read again."""
    return stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def of_sketches(found: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """(by, quantile, value, n): what each sketch gives for each quantile."""
    asked = F.array(*[F.lit(q) for q in quantiles])
    out = found.select(*by, "n", F.posexplode(F.kll_sketch_get_quantile_double("sketch", asked)).alias("_i", "value"))
    return out.select(*by, F.element_at(asked, F.col("_i") + 1).alias("quantile"), "value", "n")


def rank_errors(df: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """`found` (by, quantile, value, n) with `below` and `up_to`, the rows below each value and those not above it, and rank_error.

    rank_error is how far the quantile lies outside of the ranks that the value has, as a share of the group; ties have several ranks.
    One pass counts all rows; the values found are broadcast up to a checked size.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    asked = found.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "quantile", F.col("value").alias("_at"), "n")
    small = found.count() <= BROADCAST_ROWS
    same = F.lit(True)
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_k"))
    met = rows.join(F.broadcast(asked) if small else asked, same)
    counts = met.groupBy(*by, "quantile", F.col("_at").alias("value"), "n").agg(F.coalesce(F.sum(F.when(F.col("_v") < F.col("_at"), F.col("_k"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("_v") <= F.col("_at"), F.col("_k"))), F.lit(0)).alias("up_to"))
    return counts.withColumn("rank_error", F.greatest(F.col("below") / F.col("n") - F.col("quantile"), F.col("quantile") - F.col("up_to") / F.col("n"), F.lit(0.0)))


def exact(df: DataFrame, by: list[str], value: str, quantiles: list[float], *, few: int = FEW) -> DataFrame:
    """(by, n, quantile, value): exact quantiles per group, between two ranks by interpolation; nulls and NaN take no part, and groups without values are absent.

    Rows are counted by distinct value first, which any task can do for a share of a group. Each wanted rank then has a bracket of values that
    holds it. A round cuts the open brackets into cells by a sketch of their distinct values, counts the rows of each cell, and keeps the cell with the
    rank, until few distinct values are left or one value is all. So a group with most of the rows is counted by all tasks, and none sorts it.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    v = F.col(value).cast("double")
    counted = scratch.keep(df.select(key.alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("k")))
    sizes = scratch.keep(counted.groupBy("g").agg(F.sum("k").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("distinct")))
    # the ranks on both sides of a quantile, from 0
    each = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    ranks = sizes.select("*", each).withColumn("at", F.col("q") * (F.col("n") - 1))
    ranks = ranks.select("g", "lo", "hi", "distinct", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    open_ones, settled = scratch.keep(ranks.withColumn("below", F.lit(0).cast("long"))), None

    def inside(brackets: DataFrame) -> DataFrame:
        """The counted values of each bracket (g, rank, lo, hi, below)."""
        wanted = brackets.select(F.col("g").alias("_g"), "rank", "lo", "hi", "below")
        wanted = F.broadcast(wanted) if brackets.count() <= BROADCAST_ROWS else wanted
        return counted.join(wanted, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("_g")

    def settle(brackets: DataFrame) -> DataFrame:
        """(g, rank, v) of brackets with few distinct values: the first value whose running count passes the rank."""
        line = Window.partitionBy("g", "rank").orderBy("v")
        found = inside(brackets).withColumn("up_to", F.col("below") + F.sum("k").over(line)).where(F.col("up_to") > F.col("rank"))
        return found.groupBy("g", "rank").agg(F.min("v").alias("v"))

    for _ in range(MOST_ROUNDS):
        done = scratch.keep(settle(open_ones.where(F.col("distinct") <= few)))
        settled = done if settled is None else settled.union(done)
        open_ones = open_ones.where(F.col("distinct") > few)
        if open_ones.isEmpty():
            break
        values = inside(open_ones)
        steps = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
        cuts = values.groupBy("g", "rank").agg(F.kll_sketch_agg_double("v").alias("s")).select(F.col("g").alias("_g"), F.col("rank").alias("_rank"), F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("s", steps))).alias("cuts"))
        cuts = scratch.keep(cuts)
        cuts = F.broadcast(cuts) if open_ones.count() * CELLS <= BROADCAST_ROWS else cuts
        placed = values.join(cuts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("rank") == F.col("_rank")))
        # a cell ends at a cut and holds it; the last one has no cut
        cell = F.expr("size(filter(cuts, c -> c < v))")
        cells = placed.groupBy("g", "rank", cell.alias("cell")).agg(F.sum("k").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("distinct"), F.first("below").alias("before"))
        line = Window.partitionBy("g", "rank").orderBy("cell")  # at most `CELLS` rows
        cells = cells.withColumn("below", F.col("before") + F.sum("k").over(line) - F.col("k"))
        chosen = cells.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("k")))
        open_ones = scratch.keep(chosen.select("g", "lo", "hi", "distinct", "rank", "below"))
    else:
        raise RuntimeError("the brackets of the quantiles do not shrink")

    at = sizes.select("g", "n", each).withColumn("at", F.col("q") * (F.col("n") - 1))
    ends = at.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    for end in ("low", "high"):
        ends = ends.join(settled.select("g", F.col("rank").alias(end), F.col("v").alias(f"v_{end}")), ["g", end])
    between = F.col("v_low") + (F.col("at") - F.col("low")) * (F.col("v_high") - F.col("v_low"))
    return ends.select(*[F.col(f"g.{c}").alias(c) for c in by], "n", F.col("q").alias("quantile"), between.alias("value"))
