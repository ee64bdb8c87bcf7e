"""Intermediate tables in the shared folder, and the size of the batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.shared import Scratch, shared_dir  # noqa: F401

#: Rows and bytes of one Arrow batch at most: whole texts are long, and a worker holds a few batches at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits for Arrow batches where they are higher; results do not depend on them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = spark.conf.get(key, None)
        if found is None or not str(found).lstrip("-").isdigit() or not 0 < int(found) <= most:
            spark.conf.set(key, str(most))
