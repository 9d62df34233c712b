"""Buckets of documents, and binary blocks that buckets exchange by hash range.

Documents are dealt by a hash of their text, so copies meet in one bucket and
count once there.  A text whose copies would overfill a bucket is salted by
the document id.  Buckets
hold a bounded number of bytes, whatever the size of the corpus.

A bucket talks to the others through blocks: sorted 64-bit hashes are cut into
hash ranges (parts), each sent as one binary row and answered the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import kernels as K
from driftline.llm.common import cut, small_batches

#: Text bytes of a bucket; bounds what a Python worker holds.
BUCKET_BYTES = 4 << 20
#: Cells of text hashes by which texts with many copies are told.
CELLS = 1 << 18
#: Hashes of a range, which one task compares.
PART_HASHES = 1 << 21
#: Bytes that a row weighs besides its text.
ROW_BYTES = 16

U64 = np.uint64
NO_ID = np.iinfo(np.int64).max


def runs(key: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def deal(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int = BUCKET_BYTES, passed: bool = False) -> tuple[DataFrame, int, int]:
    """(id, text, bucket) of every row, the number of buckets, and the bytes that rows weigh.  With
    ``passed`` the other columns follow as passed_0, passed_1, ...

    Ids must be whole numbers (they become longs); other ids are refused before any job runs.  One
    narrow pass weighs the texts' copies, by cells of a text's hash: the cells whose heaviest text
    fills half a bucket or more are a table of at most CELLS rows, however many such texts there
    are, and a cell's texts are salted by the need of the heaviest."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    small_batches(docs)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES
    copies = docs.groupBy(F.xxhash64(text_col).alias("key")).agg(F.sum(size).alias("held"))
    cells = cut(copies.groupBy(F.pmod("key", F.lit(CELLS)).alias("cell")).agg(F.sum("held").alias("held"), F.max("held").alias("top")))
    total = int(cells.agg(F.sum("held")).first()[0] or 0)
    buckets = max(8, -(-total // bucket_bytes))
    hot = F.broadcast(cells.filter(F.col("top") > bucket_bytes // 2).select("cell", F.ceil(2 * F.col("top") / bucket_bytes).alias("salts")))
    others = [c for c in docs.columns if passed and c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"passed_{i}") for i, c in enumerate(others)))
    rows = rows.withColumn("key", F.xxhash64("text")).withColumn("cell", F.pmod("key", F.lit(CELLS))).join(hot, "cell", "left")
    by = F.xxhash64("id", F.when(F.col("id").isNull(), F.spark_partition_id()))  # copies without id are spread too
    salt = F.when(F.col("salts").isNotNull(), F.pmod(by, F.col("salts"))).otherwise(F.lit(0))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key", salt), F.lit(buckets)).cast("int")).drop("key", "cell", "salts"), buckets, total


def parts_for(total: int, bytes_per_hash: int) -> int:
    """Hash ranges for texts of so many bytes: each gets about PART_HASHES hashes, however many
    buckets send them."""
    return max(8, -(-total // (PART_HASHES * bytes_per_hash)))


class Bucket:
    """The texts of one bucket, each distinct text once."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("id").to_pylist()
        self.ids = np.array([NO_ID if i is None else int(i) for i in ids], np.int64)
        self.id_column = table.column("id")
        column = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        self.data, self.off = K.buffers(column)
        raw = memoryview(self.data)
        first: dict[bytes, int] = {}
        self.text_of = np.zeros(len(ids), np.int64)
        distinct: list[int] = []
        for i in range(len(ids)):
            text = bytes(raw[self.off[i] : self.off[i + 1]])
            k = first.setdefault(text, len(distinct))
            if k == len(distinct):
                distinct.append(i)
            self.text_of[i] = k
        self.rows = np.array(distinct, np.int64)
        self.text_id = np.full(len(distinct), NO_ID, np.int64)
        np.minimum.at(self.text_id, self.text_of, self.ids)

    def slices(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first distinct text, end, bytes, offsets) of about a slice each."""
        size = self.off[self.rows + 1] - self.off[self.rows]
        lo, n = 0, len(self.rows)
        total = np.concatenate([[0], np.cumsum(size)])
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + K.SLICE_BYTES, "right")) - 1)
            data = np.concatenate([self.data[self.off[r] : self.off[r + 1]] for r in self.rows[lo:hi]])
            yield lo, hi, data, total[lo : hi + 1] - total[lo]
            lo = hi


def pack(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(raw: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(raw, decompressed_size=size, asbytes=True)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers without their 15 lowest bits, as steps of four bytes where they fit."""
    v = values >> U64(15)
    step = np.diff(v, prepend=U64(0))
    if len(v) < 2 or step[1:].max() >> U64(32):
        return b"w" + v.tobytes()
    return b"s" + v[:1].tobytes() + step[1:].astype(np.uint32).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if raw[:1] == b"w":
        return np.frombuffer(raw, U64, offset=1) << U64(15)
    step = np.concatenate([np.frombuffer(raw, U64, 1, 1), np.frombuffer(raw, np.uint32, offset=9).astype(U64)])
    return np.cumsum(step, dtype=U64) << U64(15)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of each hash, ascending with it."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("block", pa.binary())])
SENT_DDL = "part int, bucket int, n int, block binary"


def blocks(key: np.ndarray, payload: np.ndarray, parts: int, bucket: int, packer: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One row per hash range; ``payload`` is ordered as ``key``, which is ascending."""
    if not len(key):
        return SENT.empty_table()
    part = part_of(key, parts)
    start = runs(part)
    end = np.append(start[1:], len(part))
    rows = [packer(payload[a:b]) for a, b in zip(start, end, strict=True)]
    return pa.table([pa.array(part[start].astype(np.int32)), pa.array(np.full(len(start), bucket, np.int32)), pa.array((end - start).astype(np.int32)), pa.array(rows, pa.binary())], schema=SENT)


