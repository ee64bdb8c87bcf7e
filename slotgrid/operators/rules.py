"""Named rules over raw rows: counts, reason arrays, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with `<rule>_rows` for each rule, in one pass."""
    return df.agg(*[F.count_if(c).alias(f"{name}_rows") for name, c in rules.items()])


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the violated rules in order; a null predicate is no violation."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def reason_counts(df: DataFrame, column: str) -> DataFrame:
    """(reason, n): rows that violate each rule."""
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def examples(df: DataFrame, column: str, key: str, k: int = 5) -> DataFrame:
    """The k rows of smallest key for each reason."""
    order = Window.partitionBy("reason").orderBy(key)
    return df.select(key, F.explode(column).alias("reason")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
