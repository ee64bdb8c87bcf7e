"""Where two large tables differ: trees of hashes over ranges of key hashes, compared from the root down, so that equal ranges are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of a node, levels below the root, and the level whose nodes are folders on disk.
FAN, DEPTH, FOLDERS_AT = 16, 4, 2
ROWS, TREE = "rows", "tree"


def _hashed(df: DataFrame, keys: list[str], depth: int, folders_at: int = 0) -> DataFrame:
    """`df` with `_leaf`, the range that the hash of the row's keys falls in, and `_folder`, its ancestor that is a folder."""
    leaf = F.pmod(F.xxhash64(*keys), F.lit(FAN**depth))
    return df.withColumn("_leaf", leaf).withColumn("_folder", F.floor(F.col("_leaf") / FAN ** (depth - folders_at)).cast("int"))


def tree(df: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(level, node, n, sum_a, sum_b): rows and two sums of row hashes of each node, level 0 being the root; a node without rows is absent.

    Sums do not depend on the order of rows, and repeated rows count each time. Rows are added up to leaves in one pass, and each level
    comes from the one below it.
    """
    hashes = [F.sum(F.xxhash64(*df.columns, F.lit(seed)).cast("decimal(38,0)")).alias(n) for n, seed in (("sum_a", 1), ("sum_b", 2))]
    leaves = _hashed(df, keys, depth).groupBy(F.col("_leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *hashes)
    # the levels of one node: at most depth + 1 rows a leaf, added up again
    up = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "*")
    ancestor = F.floor(F.col("node") / F.pow(F.lit(FAN), F.lit(depth) - F.col("level"))).cast("long")
    return up.withColumn("node", ancestor).groupBy("level", "node").agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("sum_a", "sum_b")])


def write_hashed(df: DataFrame, path: str, keys: list[str], depth: int = DEPTH, folders_at: int = FOLDERS_AT) -> None:
    """Writes `df` below `path` in a folder per range of key hashes, and its tree beside it, one folder a level; the path must be new."""
    rows = _hashed(df, keys, depth, folders_at)
    rows.hint("rebalance", "_folder").write.partitionBy("_folder").parquet(f"{path}/{ROWS}")
    stored = df.sparkSession.read.parquet(f"{path}/{ROWS}").select(*df.columns)
    tree(stored, keys, depth).coalesce(1).write.partitionBy("level").parquet(f"{path}/{TREE}")


def differing_leaves(spark: SparkSession, left: str, right: str, depth: int = DEPTH) -> DataFrame:
    """(leaf) of the ranges in which two written tables differ; of each level only the children of nodes that differ are compared."""
    found = spark.createDataFrame([(0,)], "node long")
    for level in range(depth + 1):
        sides = [spark.read.parquet(f"{path}/{TREE}").where(F.col("level") == level).select("node", "n", "sum_a", "sum_b") for path in (left, right)]
        wanted = found if level == 0 else found.select(F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1)).alias("node"))
        near = [side.join(F.broadcast(wanted), "node", "left_semi") for side in sides]  # at most FAN**depth nodes
        both = near[0].withColumn("s", F.lit(1)).unionByName(near[1].withColumn("s", F.lit(-1)))
        gap = [F.sum(F.col(c) * F.col("s")) != 0 for c in ("n", "sum_a", "sum_b")]
        found = both.groupBy("node").agg((gap[0] | gap[1] | gap[2]).alias("differ")).where("differ").select("node")
    return found.select(F.col("node").alias("leaf"))


def differences(spark: SparkSession, left: str, right: str, depth: int = DEPTH, folders_at: int = FOLDERS_AT) -> DataFrame:
    """The rows of two written tables that the other lacks, with multiplicity, and `side`; only folders with differing leaves are read.

    The folders' numbers, FAN**folders_at at most, pass through the driver to prune the scan. Equal tables have no rows.
    """
    leaves = differing_leaves(spark, left, right, depth)
    folders = [r[0] for r in leaves.select(F.floor(F.col("leaf") / FAN ** (depth - folders_at)).cast("int")).distinct().collect()]
    sides = []
    for path in (left, right):
        rows = spark.read.parquet(f"{path}/{ROWS}").where(F.col("_folder").isin(folders))
        sides.append(rows.join(F.broadcast(leaves), F.col("_leaf") == F.col("leaf"), "left_semi").drop("_leaf", "_folder"))
    out = [a.exceptAll(b).withColumn("side", F.lit(name)) for name, a, b in (("left", *sides), ("right", *sides[::-1]))]
    return out[0].unionByName(out[1])
