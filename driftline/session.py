"""Session settings that every plan relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC epoch arithmetic, adaptive plans, zstd files, partition-wise overwrite.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "driftline", master: str | None = None, **more: str) -> SparkSession:
    """A session with the package's settings; ``more`` adds or replaces settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
