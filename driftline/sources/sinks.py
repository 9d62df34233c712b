"""Writing: whole tables put in place at once, sorted cell tables, partitions, text lines, CSV."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from driftline.sources.tables import file_system

#: File of a table's folder that holds what the table was made with.
NOTE = "_note.json"


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside ``path`` to write to; it takes the place of ``path`` when the block ends.

    A failure inside the block leaves what is at ``path`` as it was.  A reader sees the old table,
    for the moment between two renames none, then the new one, and never a part of either."""
    fs, target = file_system(spark, path)
    type_path = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old = (type_path(target.getParent(), f"_{kind}-{uuid.uuid4().hex}") for kind in ("staged", "old"))
    try:
        yield fresh.toString()
        fs.mkdirs(target.getParent())
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"cannot move {path}")
        if not fs.rename(fresh, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"cannot replace {path}")
        if had:
            fs.delete(old, True)
    except BaseException:
        fs.delete(fresh, True)
        raise


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def note(spark: SparkSession, path: str) -> object:
    """What a table was made with, as given to :func:`write`; none if nothing was."""
    fs, target = file_system(spark, f"{path}/{NOTE}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def write(df: DataFrame, path: str, *, partition: str | None = None, made_with: object = None) -> None:
    """zstd Parquet.  A whole table is written beside the old one and then put in its place; with
    ``partition`` only the partitions present in ``df`` are replaced, by Spark's own staging."""
    writer = df.write.option("compression", "zstd")
    if partition:
        writer.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    with staged(df.sparkSession, path) as folder:
        writer.parquet(folder)
        if made_with is not None:
            _put(df.sparkSession, f"{folder}/{NOTE}", json.dumps(made_with))


def write_cells(df: DataFrame, path: str, *, key: str = "h3_cell") -> None:
    """Range-partitioned and sorted by cell, so that lookups prune files and row groups."""
    write(df.repartitionByRange(key).sortWithinPartitions(key), path)


def write_lines(df: DataFrame, path: str, column: str = "json_text", *, single: bool = False, name: str | None = None, kind: str = "txt") -> list[str]:
    """One text line per row, gzip; ``single`` makes one file for tools that need it.  The paths of
    the files; with ``name`` they are called NAME-00000.KIND.gz and so on."""
    spark = df.sparkSession
    lines = df.select(column)
    with staged(spark, path) as folder:
        (lines.coalesce(1) if single else lines).write.option("compression", "gzip").text(folder)
        fs, root = file_system(spark, folder)
        type_path = spark._jvm.org.apache.hadoop.fs.Path
        files = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-"))
        if name:
            made = [f"{name}-{i:05d}.{kind}.gz" for i in range(len(files))]
            for old, new in zip(files, made, strict=True):
                fs.rename(type_path(root, old), type_path(root, new))
            files = made
    return [f"{path}/{f}" for f in files]


def csv_text(page: DataFrame) -> str:
    """A page of rows as CSV text with header; pages are bounded by their limit."""
    return page.toPandas().to_csv(index=False, lineterminator="\r\n")


def json_rows(page: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in page.collect()]
