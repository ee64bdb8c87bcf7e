"""What a series on a fixed-cadence grid looks like."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """Column names, step in seconds, and how many slots history and future span."""

    entity: str = "entity"
    epoch: str = "slot"
    value: str = "v"
    step: int = 300
    history: int = 12
    future: int = 6
    #: Columns besides the entity that part a series, such as time buckets.
    within: tuple[str, ...] = ()

    def window(self) -> WindowSpec:
        """One partitioning and order for all windows of a job, so that they share one exchange and sort."""
        return Window.partitionBy(self.entity, *self.within).orderBy(self.epoch)

    def span(self, first: int, last: int) -> WindowSpec:
        """Exact-time range from `first` to `last` slots away."""
        return self.window().rangeBetween(first * self.step, last * self.step)


def epoch_of(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def to_grid(events: DataFrame, spec: GridSpec, *, entity: str, ts: str, value: str, order: str, scale: str = "decimal(18,2)") -> DataFrame:
    """(entity, epoch, value, n): one row per entity and occupied slot, the value being that of the smallest `order`."""
    at = epoch_of(F.col(ts))
    return (
        events.select(F.col(entity).alias(spec.entity), (at - F.pmod(at, F.lit(spec.step))).alias(spec.epoch), F.col(value).alias("_v"), F.col(order).alias("_o"))
        .groupBy(spec.entity, spec.epoch)
        .agg(F.min_by("_v", "_o").cast(scale).alias(spec.value), F.count(F.lit(1)).alias("n"))
    )
