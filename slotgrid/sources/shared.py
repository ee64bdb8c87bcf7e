"""Intermediate tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Where it is unset, a local session gets a folder of its own; on a cluster that would lose data, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="slotgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Writes tables as Parquet below the shared folder and reads them back; `codec` is the files' compression, else the session's."""

    def __init__(self, spark: SparkSession, name: str, codec: str | None = None):
        self.spark = spark
        self.options = {"compression": codec} if codec else {}
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        """A new path below this job's folder."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        """`options` are the writer's, for this table alone."""
        path = self.path()
        df.write.options(**self.options | options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
