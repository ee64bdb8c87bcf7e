"""Join audits, keyed comparisons and table signatures."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the arithmetic row number.
FACTORS, MODULUS = (7_919, 104_729, 611_953, 746_773), 1_000_003


def any_null(keys: list[str]) -> Column:
    """Whether some of the columns is null."""
    return functools.reduce(operator.or_, [F.col(k).isNull() for k in keys])


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys on the left only, on the right only, and joined."""
    a, b = left.select(*keys, F.lit(1).alias("_l")), right.select(*keys, F.lit(1).alias("_r"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.sum(F.col("_r").isNull().cast("long")).alias("left_only"),
        F.sum(F.col("_l").isNull().cast("long")).alias("right_only"),
        F.sum((F.col("_l").isNotNull() & F.col("_r").isNotNull()).cast("long")).alias("joined"),
    )


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row; a union and an aggregate instead of a join without keys. Names must differ."""
    names = [c for row in rows for c in row.columns]
    wide = [row.select(*[F.col(c) if c in row.columns else F.lit(None).alias(c) for c in names]) for row in rows]
    out = wide[0]
    for other in wide[1:]:
        out = out.union(other)
    return out.agg(*[F.max(c).alias(c) for c in names])


def hashed(columns: list[str], seed: int) -> Column:
    """The 64-bit hash of some columns of a row."""
    return F.xxhash64(*columns, F.lit(seed)) if seed else F.xxhash64(*columns)


def arithmetic(columns: list[str], seed: int) -> Column:
    """A number below 1,000,003 from whole-number columns, by primes that other engines can multiply by as well; a null counts as -1."""
    total = F.lit(seed).cast("long")
    for factor, c in zip(itertools.cycle(FACTORS), columns):
        total = F.pmod(total * 31 + F.pmod(F.coalesce(F.col(c).cast("long"), F.lit(-1)), F.lit(MODULUS)) * factor, F.lit(MODULUS))
    return total


def signature(df: DataFrame, by: list[str], columns: list[str], sums: int = 1, number: Callable[[list[str], int], Column] = hashed) -> DataFrame:
    """Row count and sums of row numbers per group, each with a seed of its own; equal tables have equal signatures whatever their order."""
    found = [F.sum(number(columns, k).cast("decimal(38,0)")).alias(f"hash_sum_{k}" if k else "hash_sum") for k in range(sums)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *found)


def column_signature(df: DataFrame, keys: list[str], columns: list[str], number: Callable[[list[str], int], Column] = hashed) -> DataFrame:
    """(name, n, nulls, hash_sum) per column, its number taken together with the keys, so that swapped values show; one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(number([*keys, c], 0).cast("decimal(38,0)")).alias(f"h_{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in columns],
    )
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col("_n").alias("n"), F.col(f"z_{c}").alias("nulls"), F.col(f"h_{c}").alias("hash_sum")) for c in columns])
    return row.select(F.inline(each))


def lookup(df: DataFrame, side: DataFrame, keys: list[str], how: str = "left", limit: int = 1_000_000) -> DataFrame:
    """Join with a side table of unique keys; it is broadcast only if it has at most `limit` rows, and shuffled otherwise."""
    small = side.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(side) if small else side, keys, how)


def compare_columns(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(name, compared, unequal, null_mismatch, max_difference, only_left, only_right) per numeric column.

    Keys are unique on each side. Both sides are stacked with a tag and meet in one exchange by key, where tag 1 is the left, 2 the right, and 3
    their sum; a row with a null key meets nothing. Nulls equal nulls, and keys on one side alone are counted and not compared.
    """
    def tagged(df: DataFrame, tag: int) -> DataFrame:
        alone = F.when(any_null(keys), F.monotonically_increasing_id() * 2 + tag)
        return df.select(*keys, alone.alias("_alone"), F.lit(tag).alias("_tag"), *columns)

    def of(tag: int, c: str) -> Column:
        return F.max(F.when(F.col("_tag") == tag, F.col(c)))

    met = tagged(left, 1).unionByName(tagged(right, 2)).groupBy(*keys, "_alone").agg(F.sum("_tag").alias("_tags"), *[F.struct(of(1, c).alias("x"), of(2, c).alias("y")).alias(c) for c in columns])
    each = []
    for c in columns:
        x, y = F.col(c)["x"], F.col(c)["y"]
        each.append(F.struct(F.lit(c).alias("name"), (~x.eqNullSafe(y)).alias("differ"), (x.isNull() != y.isNull()).alias("lost"), F.abs(x - y).cast("double").alias("gap")))
    pairs = met.select("_tags", F.inline(F.array(*each)))
    met_both = F.col("_tags") == 3
    return pairs.groupBy("name").agg(
        F.count_if(met_both).alias("compared"), F.count_if(met_both & F.col("differ")).alias("unequal"), F.count_if(met_both & F.col("lost")).alias("null_mismatch"),
        F.max(F.when(met_both, F.col("gap"))).alias("max_difference"), F.count_if(F.col("_tags") == 1).alias("only_left"), F.count_if(F.col("_tags") == 2).alias("only_right"),
    )


def unequal_examples(left: DataFrame, right: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, place): the k smallest keys present on both sides whose values differ; nulls equal nulls."""
    both = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys).where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.orderBy(*keys).limit(k).select(*keys, F.row_number().over(Window.orderBy(*keys)).alias("place"))


def inflation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows of the left, rows after a left join, and how many the join adds."""
    many = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = left.join(many, keys, "left").agg(F.count(F.lit(1)).alias("left_rows"), F.sum(F.coalesce("_n", F.lit(1))).alias("joined_rows"))
    return out.withColumn("inflation", F.col("joined_rows") - F.col("left_rows"))


def guard_join(left: DataFrame, right: DataFrame, keys: list[str], *, require_all_left: bool = False, require_all_right: bool = False) -> DataFrame:
    """One row that says whether a one-to-one join is safe: rows, null and repeated keys of each side, matches, match rates, PASS or FAIL.

    Both sides share one exchange: a union with flags, counted per key. Any null or repeated key fails, as does a key without
    a match on a side that requires all. Rates are null for a side without keys.
    """
    null = any_null(keys)
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    per_key = sides.groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    out = per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.when(null, F.col("l"))), F.lit(0)).alias("left_null_keys"), F.coalesce(F.sum(F.when(null, F.col("r"))), F.lit(0)).alias("right_null_keys"),
        count(~null & (F.col("l") > 1)).alias("left_duplicates"), count(~null & (F.col("r") > 1)).alias("right_duplicates"),
        count(~null & (F.col("l") > 0)).alias("_lk"), count(~null & (F.col("r") > 0)).alias("_rk"), count(~null & (F.col("l") > 0) & (F.col("r") > 0)).alias("matched_keys"),
    )
    bad = F.col("left_null_keys") + F.col("right_null_keys") + F.col("left_duplicates") + F.col("right_duplicates") > 0
    if require_all_left:
        bad = bad | (F.col("matched_keys") < F.col("_lk"))
    if require_all_right:
        bad = bad | (F.col("matched_keys") < F.col("_rk"))
    rates = {f"{s}_match_rate": F.when(F.col(k) > 0, F.col("matched_keys") / F.col(k)) for s, k in (("left", "_lk"), ("right", "_rk"))}
    return out.withColumns({**rates, "verdict": F.when(bad, "FAIL").otherwise("PASS")}).drop("_lk", "_rk")


def counted_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows of each side and of their inner join, and whether the join keeps every left row exactly."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    out = sides.groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r")).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum(F.col("l") * F.col("r")).alias("joined_rows"))
    return out.withColumn("whole", (F.col("joined_rows") == F.col("left_rows")).cast("long"))


def score_difference(left: DataFrame, right: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """One row: matched keys and the largest absolute difference of two score tables."""
    both = left.select(*keys, F.col(p).alias("_a")).join(right.select(*keys, F.col(p).alias("_b")), keys)
    return both.agg(F.count(F.lit(1)).alias("matched"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))


def partition_violations(df: DataFrame, epoch: str, day: str, shifts: dict[str, int]) -> DataFrame:
    """Per day partition and named shift in seconds: rows whose shifted epoch falls on another day."""
    return df.groupBy(day).agg(*[F.sum((F.dayofmonth(F.timestamp_seconds(F.col(epoch) + s)) != F.col(day)).cast("long")).alias(n) for n, s in shifts.items()])


def existence(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with 1 for each condition that some row meets, else 0; nulls meet none."""
    return df.agg(*[F.coalesce(F.max(c.cast("long")), F.lit(0)).alias(n) for n, c in conditions.items()])
