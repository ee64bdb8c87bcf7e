"""Raw lines, CSV decoding, contract-checked Parquet and write-once sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_stats(lines: DataFrame, header: str, column: str = "value") -> DataFrame:
    """One row: lines, header_lines, blank_lines."""
    c = F.col(column)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum((c == header).cast("long")).alias("header_lines"), F.sum((F.length(F.trim(c)) == 0).cast("long")).alias("blank_lines"))


def decode_csv(line: Column, names: list[str]) -> Column:
    """All-string struct of a CSV line with `_corrupt_record` set where fields are missing, extra or unbalanced."""
    schema = ", ".join(f"`{n}` STRING" for n in [*names, "_corrupt_record"])
    return F.from_csv(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "escape": '"'})


def read_contract(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """Parquet whose names and types equal the contract; anything else is refused."""
    df = spark.read.parquet(path)
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in contract}
    if have != want:
        raise ValueError(f"schema drift at {path}: {sorted(have.items() ^ want.items(), key=str)}")
    return df


def write_partitioned(df: DataFrame, path: str, by: list[str], partitions: int | None = None) -> None:
    """Overwrites `path`, partitioned by `by`, dealt out by the same columns so that each folder gets few files."""
    dealt = df.repartition(partitions, *by) if partitions else df.repartition(*by)
    dealt.write.mode("overwrite").option("compression", "snappy").partitionBy(*by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes `df`; an error if the path is there already."""
    df.write.mode("errorifexists").parquet(path)


def read_partition(spark: SparkSession, root: str, part: str) -> DataFrame:
    """One partition folder with its partition columns."""
    return spark.read.option("basePath", root).parquet(f"{root}/{part}")


def read_strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header of a fixed schema; a malformed row fails the job, and the header must name the schema's columns."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)


def read_tables(spark: SparkSession, root: str, contracts: dict[str, T.StructType], zone: str | None = None) -> dict[str, DataFrame]:
    """The named tables of a root, each held against its contract; a zone, where given, becomes that of the session, since calendar fields of the tables depend on it."""
    if zone:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return {name: read_contract(spark, f"{root}/{name}", contract) for name, contract in contracts.items()}


def write_small(df: DataFrame, path: str) -> None:
    """A small side table as one file."""
    df.coalesce(1).write.parquet(path)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each table that the other lacks, with multiplicity, and the rows of the first; one aggregate over both."""
    columns = a.columns
    sides = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    per_row = sides.groupBy(*columns).agg(F.sum("_s").alias("d"), F.sum((F.col("_s") == 1).cast("long")).alias("k"))
    zero = F.lit(0).cast("long")
    return per_row.agg(F.coalesce(F.sum(F.greatest(F.col("d"), zero)), zero).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("d"), zero)), zero).alias("only_right"), F.coalesce(F.sum("k"), zero).alias("written"))
