"""Rows that share a key after alignment: crowded keys, what becomes of each row, and the balance of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import side_by_side


def collision_stats(df: DataFrame, keys: list[str], value: str, metadata: list[str]) -> DataFrame:
    """(keys, n, value_variants, metadata_variants) of the keys with more than one row; nulls are no variant of a value, and a null key is a key like any other."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("value_variants"), F.count_distinct(F.struct(*metadata)).alias("metadata_variants"))
    return stats.where("n > 1")


def verdicts(df: DataFrame, keys: list[str], value: str, metadata: list[str], order: list[str], row_id: str) -> DataFrame:
    """(row_id, collision_rank, retained_id, metadata_variants, disposition) of the rows on crowded keys alone.

    Only the columns named here are shuffled. A key whose rows have several values refuses them all; otherwise its first row in
    `order` stands for the rest.
    """
    crowded = collision_stats(df, keys, value, metadata)
    named = crowded.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("value_variants") > 1).alias("_torn"), "metadata_variants")
    same_key = F.lit(True)
    for i, k in enumerate(keys):
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    line = Window.partitionBy(*keys).orderBy(*order)
    narrow = df.select(*dict.fromkeys([*keys, *order, row_id])).join(named, same_key)
    placed = narrow.withColumns({"collision_rank": F.row_number().over(line), "retained_id": F.first_value(row_id).over(line)})
    fate = F.expr("CASE WHEN _torn THEN 'quarantined' ELSE element_at(array('kept', 'merged'), least(collision_rank, 2)) END")
    return placed.select(row_id, "collision_rank", "retained_id", "metadata_variants", fate.alias("disposition"))


def resolve(df: DataFrame, keys: list[str], value: str, metadata: list[str], order: list[str], row_id: str) -> DataFrame:
    """`df` with collision_rank, retained_id, metadata_variants and disposition: unique, kept, merged, or quarantined.

    `row_id` is unique and never null. Whole rows meet the verdicts on crowded keys by their id, so where collisions are few the verdicts
    are broadcast and whole rows are neither shuffled nor sorted. Rows that share a null key collide too.
    """
    found = verdicts(df, keys, value, metadata, order, row_id)
    out = df.join(found, row_id, "left")
    rest = {"collision_rank": F.lit(1), "retained_id": F.col(row_id), "metadata_variants": F.lit(1).cast("long"), "disposition": F.lit("unique")}
    return out.withColumns({name: F.coalesce(F.col(name), plain) for name, plain in rest.items()})


def balance_measures(amount: Column) -> dict[str, Column]:
    """The aggregates of the balance by name: rows and amounts that came in, stayed, were merged or quarantined."""
    states = {"raw": ["unique", "kept", "merged", "quarantined"], "kept": ["unique", "kept"], "merged": ["merged"], "quarantined": ["quarantined"]}
    out = {}
    for name, ones in states.items():
        inside = F.col("disposition").isin(ones)
        out[f"{name}_rows"] = F.count_if(inside)
        out[f"{name}_amount"] = F.coalesce(F.sum(F.when(inside, amount)), F.lit(0))
    return out


def with_balance(row: DataFrame) -> DataFrame:
    """A row of balance measures with rows_balance and amount_balance: 1 where what came in equals what stayed, was merged and was quarantined."""
    def adds_up(what: str) -> Column:
        parts = [F.col(f"{name}_{what}") for name in ("kept", "merged", "quarantined")]
        return (F.col(f"raw_{what}") == parts[0] + parts[1] + parts[2]).cast("long")

    return row.withColumns({f"{what}_balance": adds_up(what) for what in ("rows", "amount")})


def balance(df: DataFrame, amount: Column) -> DataFrame:
    """One row: rows and amounts that came in, stayed, were merged or quarantined, and whether both add up."""
    return with_balance(df.agg(*[c.alias(name) for name, c in balance_measures(amount).items()]))


def what_if(df: DataFrame, entity: str, before: str, after: str, value: str, metadata: list[str], day: Column, new_day: Column) -> DataFrame:
    """One row about a proposed change of the epoch, which is not applied: keys, collisions, conflicts, changed dates, and rows kept under three policies.

    All follows from the crowded keys under the new epoch and the number of rows: a key that is not crowded holds one row. `added_groups` is the number
    of crowded keys beyond those that the old epoch has already.
    """
    rows = df.agg(F.count(F.lit(1)).alias("rows_keep_all"), F.count_if(day != new_day).alias("date_changes"))
    then = collision_stats(df, [entity, after], value, metadata).agg(
        F.count(F.lit(1)).alias("collision_groups"), F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).alias("excess_rows"),
        F.count_if(F.col("value_variants") > 1).alias("value_conflicts"), F.count_if(F.col("metadata_variants") > 1).alias("metadata_conflicts"),
    )
    now = df.groupBy(entity, before).count().agg(F.count_if(F.col("count") > 1).alias("groups_before"))
    out = side_by_side(rows, then, now)
    left = F.col("rows_keep_all") - F.col("excess_rows")
    return out.select(
        left.alias("keys"), "collision_groups", (F.col("collision_groups") - F.col("groups_before")).alias("added_groups"), "excess_rows", "value_conflicts", "metadata_conflicts", "date_changes",
        "rows_keep_all", left.alias("rows_keep_first"), (left - F.col("value_conflicts")).alias("rows_drop_conflicts"),
    )
