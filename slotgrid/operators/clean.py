"""Collisions on the grid, phase alignment, ledgers and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_phase(epoch: Column, step: int, phase: int, shift: int, applies: Column) -> Column:
    """Epoch moved by `shift` seconds where it stands `phase` seconds into a step and `applies` holds."""
    return F.when(applies & (F.pmod(epoch, F.lit(step)) == phase), epoch + shift).otherwise(epoch)


def ledger(df: DataFrame, amount: str) -> DataFrame:
    """Rows and decimal amount by disposition."""
    return df.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("amount"))


def key_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, n_values): rows and distinct values of each key; a null value is none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("n_values"))


def duplicate_summary(profile: DataFrame) -> DataFrame:
    """One row over a key profile: keys, groups with more than one row, their excess, and groups whose values differ."""
    many = F.col("n") > 1
    return profile.agg(
        F.count(F.lit(1)).alias("unique_keys"),
        F.sum(many.cast("long")).alias("duplicate_groups"),
        F.sum(F.col("n") - 1).alias("excess_rows"),
        F.sum((many & (F.col("n_values") > 1)).cast("long")).alias("conflicting_groups"),
    )


def gaps(df: DataFrame, entity: str, epoch: str) -> DataFrame:
    """Seconds to the row before, as a histogram over all series."""
    gap = F.col(epoch) - F.lag(epoch).over(Window.partitionBy(entity).orderBy(epoch))
    return df.select(gap.alias("gap_s")).where("gap_s IS NOT NULL").groupBy("gap_s").agg(F.count(F.lit(1)).alias("n"))


def duplicate_profile(df: DataFrame, keys: list[str], reading: list[str], valid: Column) -> DataFrame:
    """(keys, n, distinct_rows, distinct_readings, candidate_rows) of each key: its rows, those that differ in some column, those that differ in `reading`, and those that are valid.

    Rows are counted as wholes, then by reading, then by key, each from the counts before, so a key with many copies is a few rows after the
    first step and no set of values is held. Nulls are equal to each other.
    """
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_valid"))
    by_reading = whole.groupBy(*keys, *reading).agg(F.sum("_n").alias("_n"), F.sum("_valid").alias("_valid"), F.count(F.lit(1)).alias("_rows"))
    return by_reading.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_rows").alias("distinct_rows"), F.count(F.lit(1)).alias("distinct_readings"), F.sum("_valid").alias("candidate_rows"))


def duplicate_totals(profile: DataFrame) -> DataFrame:
    """One row over a duplicate profile: rows, keys, keys that rows share and their rows, rows beyond one a key, exact copies, keys with several readings, and keys with a valid row."""
    shared = F.col("n") > 1
    out = profile.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_keys"), F.count_if(shared).alias("shared_keys"), F.sum(F.when(shared, F.col("n"))).alias("rows_on_shared_keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("excess_rows"), F.sum(F.col("n") - F.col("distinct_rows")).alias("exact_copies"),
        F.count_if(F.col("distinct_readings") > 1).alias("conflicting_keys"), F.count_if(F.col("candidate_rows") > 0).alias("candidate_keys"),
    )
    return out.na.fill(0)


def variant_history(df: DataFrame, entity: str, metadata: list[str], epoch: str) -> DataFrame:
    """(entity, metadata, n, first, last): rows and epochs of each variant of an entity's metadata; the times of two variants may overlap."""
    return df.groupBy(entity, *metadata).agg(F.count(F.lit(1)).alias("n"), F.min(epoch).alias("first"), F.max(epoch).alias("last"))


def variant_counts(history: DataFrame, entity: str, metadata: list[str]) -> DataFrame:
    """(entity, n, first, last, `<column>_variants`): an entity's rows, epochs and how many values each metadata column has had, from its variants; nulls are none."""
    counts = [F.size(F.collect_set(c)).cast("long").alias(f"{c}_variants") for c in metadata]  # variants of one entity, not rows
    return history.groupBy(entity).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), *counts)
