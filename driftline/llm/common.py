"""What the operators share: reading tables, safe checkpoints, label folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker; with several cores an executor holds a few.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches by bytes: rows of text differ widely in
    size, so a bound on rows alone lets a batch grow with the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def keep_clashing(df: DataFrame, *made: str) -> DataFrame:
    """``df`` with columns that bear the name of a column to be made renamed to it with ``_input``
    behind (and underscores, until the name is free).  Names are compared without regard to case."""
    taken = {c.lower() for c in (*df.columns, *made)}
    for c in df.columns:
        if c.lower() in {m.lower() for m in made}:
            name = f"{c}_input"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            df = df.withColumnRenamed(c, name)
    return df


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without stands for the cluster's default file system, which is
    not each machine's own disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only a local session may leave it
    unset (tests do); a temporary folder then becomes the checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="driftline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return qualified(spark, named)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """:func:`cut`, and the folder of the table, for callers that know when it may go."""
    path = f"{shared_dir(df.sparkSession)}/driftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write to a table of its own in the shared checkpoint folder and read it back: the lineage
    ends there, and a lost executor costs no recomputation of what lies before."""
    return cut_at(df)[0]


#: Folders of the tables that this process has cut and not removed.
_made: list[str] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Remove, when the block ends, the tables that were cut in it.  What is computed from them must
    be written by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            remove(spark, path)
        del _made[before:]


#: Rows of a key from which on :func:`join_per_key` deals them out, and how many such keys it knows.
HOT_ROWS = 256
HOT_KEYS = 8192
#: Parts of one key at most.
HOT_PARTS = 1024


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with one row per key, where one key may hold a third of the rows.

    ``per_key`` tells in ``count`` how many rows a key has, at least.  Of the keys with more than
    HOT_ROWS the HOT_KEYS largest (a table of that bound, broadcast) are salted: their rows go to
    several tasks by a hash of all columns, and the key's row to each of these.  Any other key has
    less than one row in HOT_KEYS.  No row is left out, and the result does not depend on the salt."""
    hot = per_key.filter(F.col(count) > HOT_ROWS).orderBy(F.desc(count), key).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(F.col(key).alias("_hot"), F.least(F.lit(HOT_PARTS), F.ceil(F.col(count) / HOT_ROWS)).cast("int").alias("_parts")))
    spread = lambda df: df.join(hot, F.col(key) == F.col("_hot"), "left")
    salted = spread(rows).withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).otherwise(0))
    copied = spread(per_key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return salted.drop("_hot", "_parts").join(copied.drop("_hot", "_parts"), [key, "_salt"]).drop("_salt")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)
