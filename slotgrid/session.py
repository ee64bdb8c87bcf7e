"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "slotgrid", *, master: str | None = None, zone: str = "UTC", shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with ANSI casts, adaptive execution with skew handling, and a fixed zone; cluster settings stay untouched unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": zone,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
