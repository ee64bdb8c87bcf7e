"""Series stored in partitions by calendar period: pruned reads with context, and the rewriting of single periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridSpec
from ..operators.windows import padded

PERIOD = "period"
#: Rows of one file at most.
MOST_ROWS = 5_000_000


def period_of(epoch: Column, unit: str) -> Column:
    """First day, in the session zone, of the period (`day`, `week`, `month`, `quarter` or `year`) that an epoch falls in."""
    return F.date_trunc(unit, F.timestamp_seconds(epoch)).cast("date")


def write_periods(df: DataFrame, path: str, epoch: str, unit: str, *, replace: bool = False, most_rows: int = MOST_ROWS) -> None:
    """Writes `df` below `path` in one folder a period; a period's rows are dealt to as many tasks as their size asks for, and no file has more than `most_rows`.

    With `replace`, the periods that `df` has rows of are replaced and all other folders stay as they are, their files untouched;
    without it the path must be new. An epoch that is null goes to the folder of the null period.
    """
    dealt = df.withColumn(PERIOD, period_of(F.col(epoch), unit)).hint("rebalance", PERIOD)
    writer = dealt.write.mode("overwrite" if replace else "errorifexists").option("maxRecordsPerFile", most_rows).partitionBy(PERIOD)
    (writer.option("partitionOverwriteMode", "dynamic") if replace else writer).parquet(path)


def read_periods(spark: SparkSession, path: str, unit: str, start: int, stop: int) -> DataFrame:
    """The rows of the periods that hold epochs from `start` to before `stop`; the bounds are constants, so only those folders are listed for reading."""
    first, last = (period_of(F.lit(at).cast("long"), unit) for at in (start, stop - 1))
    return spark.read.parquet(path).where(F.col(PERIOD).between(first, last))


def padded_period(spark: SparkSession, path: str, unit: str, spec: GridSpec, start: int, stop: int, build: Callable[[DataFrame, GridSpec], DataFrame]) -> DataFrame:
    """`build` for the epochs from `start` to before `stop` alone, from the folders of those epochs and of what their windows see."""
    seen = start - (spec.history - 1) * spec.step, stop + spec.future * spec.step + 1
    return padded(read_periods(spark, path, unit, *seen).drop(PERIOD), spec, start, stop, build)
