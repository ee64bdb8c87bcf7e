"""Tables written together with their ledger: the counts come from the job that writes, not from reading again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_observed(df: DataFrame, path: str, measures: dict[str, Column], by: list[str]) -> DataFrame:
    """Writes `df` below `path`, partitioned by `by`, and gives one row of the aggregates `measures` over what was written.

    Rows are dealt out before they are measured, so the measures are taken by the tasks that write: Spark counts each of those once,
    though a task or a whole stage before it may run again after an executor is lost. A large partition goes to several tasks. The path must
    be new. Measures of an empty table are those of an aggregate without rows: counts 0, sums null unless they are coalesced.
    """
    named = [c.alias(name) for name, c in measures.items()]
    seen = Observation()
    df.hint("rebalance", *by).observe(seen, *named).write.partitionBy(*by).parquet(path)
    found = seen.get
    schema = df.agg(*named).schema
    return df.sparkSession.createDataFrame([tuple(found[f.name] for f in schema)], schema)


def written_rows(df: DataFrame, path: str, by: list[str], checks: dict[str, Column]) -> DataFrame:
    """`write_observed` with the number of rows as `n` and, for each check, how many rows fail it (a null result fails) as `<name>_rows`."""
    failed = {f"{name}_rows": F.count_if(~F.coalesce(c, F.lit(False))) for name, c in checks.items()}
    return write_observed(df, path, {"n": F.count(F.lit(1)), **failed}, by)
