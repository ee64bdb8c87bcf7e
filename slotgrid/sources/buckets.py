"""Tables bucketed alike on disk, which join on their keys without moving rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """`df` written below `path` in `buckets` files by the hash of its keys, as a table that Spark knows to be dealt so.

    One shuffle deals the rows out, and each task writes the one bucket it has. The name lives in the session's catalog under
    a number of its own; the path must be new. Keys that repeat too often make a bucket large, so take keys that are nearly unique.
    """
    name = f"slotgrid_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join of two tables of `write_bucketed` with the same keys and number of buckets: bucket meets bucket, so no row is exchanged."""
    return left.hint("merge").join(right, keys, how)


def whole_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """`bucketed_join` that must give each row of both sides once; anything else is an error.

    Keys of one side that the other lacks, or that repeat, show in the counts: the three must be equal, and null keys match nothing.
    """
    out = bucketed_join(left, right, keys)
    sides, met = [df.count() for df in (left, right)], out.count()
    repeated = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() for df in (left, right)]
    if any(repeated) or sides != [met, met]:
        raise ValueError(f"the join gives {met} rows for {sides[0]} and {sides[1]}" + " with keys that repeat" * any(repeated))
    return out
