"""Reading: files, lists, globs, drifting schemas, Arrow tables, dated files, views."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DATED = re.compile(r"_(\d{4}-\d{2}-\d{2})(?:\.parquet)?/?$")


def parquet(spark: SparkSession, *paths: str, schema: StructType | None = None, merge: bool = False) -> DataFrame:
    """One file, a list of files or a glob; with ``merge`` the columns of all files, null where a
    file lacks one."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", str(merge).lower())
    return reader.parquet(*paths)


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop for a path of any scheme; without one the cluster's default holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def register(frames: Mapping[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def dated(paths: Iterable[str]) -> dict[str, str]:
    """date -> path of the paths that end in a date; others are left out."""
    return {m[1]: p for p in sorted(paths) if (m := DATED.search(p))}


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """Children of a folder on any file system that Spark reads; none if it is missing."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(path))


def modified(spark: SparkSession, path: str) -> int | None:
    """Latest modification time (ms) of the files of a table, by their status; none without files."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    status = fs.getFileStatus(p)
    times = [s.getModificationTime() for s in fs.listStatus(p)] if status.isDirectory() else [status.getModificationTime()]
    return max(times, default=None)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(f"distinct_{column}"))


def surrogate_states(events: DataFrame) -> DataFrame:
    """Position reports derived from the ``events`` table by fixed arithmetic, for tables without
    positions.  ``event_id`` breaks ties."""
    code = F.create_map(*(F.lit(x) for pair in (("error", "7700"), ("purchase", "7600"), ("signup", "7500"), ("view", "1200")) for x in pair))
    spread: Column = lambda factor, span: F.pmod(F.col("event_id") * factor, F.lit(span)).cast("double")
    return events.select(
        F.col("user_id").cast("string").alias("icao24"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"),
        "event_id",
        (spread(7919, 18000) / 100 - 90).alias("lat"),
        (spread(104729, 36000) / 100 - 180).alias("lon"),
        code[F.col("event_type")].alias("squawk"),
        (F.col("value") < 20).alias("onground"),
        F.lit(False).alias("alert"),
        F.col("ts").cast("date").cast("string").alias("day"),
    )
