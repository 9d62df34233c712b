"""Near-duplicate vectors by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and a fast Hadamard
transform; a hash is the signed coordinate of largest magnitude.  A table
concatenates several hashes; each vector also probes the buckets that its
closest second choices name.  Members of a bucket are compared by exact cosine
in double precision, in blocks of bounded size, and give spanning links, never
all pairs.  Links are counted afterwards inside each component, block by block.
Members are dealt to blocks by a hash, so no task numbers or sorts a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import kernels as K
from driftline.llm.common import cut, join_per_key
from driftline.llm.components import components, spanning

#: Vectors of a block, about; a larger bucket or component is compared block against block.
BLOCK = 1024


@dataclass(frozen=True)
class Tables:
    """``hashes`` per table, number of ``tables``, ``probes`` per table (its own bucket included)."""

    hashes: int
    tables: int
    probes: int

    @staticmethod
    def of(vectors: int, dim: int) -> Tables:
        """Enough hashes that unrelated vectors rarely share a bucket, and tables and probes that
        find pairs of cosine 0.93 with probability 0.99."""
        hashes = max(2, math.ceil(math.log(max(vectors, 2)) / math.log(2 * max(dim, 2))))
        return Tables(hashes, 4 * hashes, 2 if hashes == 2 else 4)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def buckets(x: np.ndarray, tables: Tables, seed: int = 11) -> np.ndarray:
    """Bucket keys of unit rows: an array (rows, tables, probes); the first probe is the row's own."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    out = np.empty((n, tables.tables, tables.probes), np.uint64)
    for t in range(tables.tables):
        rng = np.random.Generator(np.random.PCG64([seed, t]))
        first, second, gap = [], [], []
        for _ in range(tables.hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice(np.array([-1.0, 1.0]), width))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            value = np.take_along_axis(size, top, 1)
            swap = value[:, 0] < value[:, 1]
            top[swap] = top[swap][:, ::-1]
            signed = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            first.append(signed[:, 0])
            second.append(signed[:, 1])
            gap.append(np.abs(value[:, 0] - value[:, 1]))
        code, other = np.stack(first, 1).astype(np.uint64), np.stack(second, 1).astype(np.uint64)
        by_gap = np.argsort(np.stack(gap, 1), axis=1)
        for p in range(tables.probes):  # bit i of p: the hash of i-th least gap takes its second choice
            probe = code.copy()
            for i in range(p.bit_length()):
                if p >> i & 1 and i < tables.hashes:
                    at = by_gap[:, i]
                    probe[np.arange(n), at] = other[np.arange(n), at]
            key = np.full(n, t + 1, np.uint64)
            for k in range(tables.hashes):
                key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + probe[:, k])
            out[:, t, p] = key
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled by their largest magnitude, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return x @ y.T >= least * np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))


def _in_blocks(members: DataFrame, key: str) -> DataFrame:
    """(key, node, block, lo, hi): each member once per pair of blocks (lo <= hi) of its key that its
    block is part of.  ``members`` has ``n``, the number of rows of the key."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.select(key, "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with")).distinct()
    return own.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")}).drop("with")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, places of the lower block, places of the higher one)."""
    x = _vectors(table.column("embedding").combine_chunks())
    block, lo, hi = table.column("block").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    return x, np.flatnonzero(block == lo), np.flatnonzero(block == hi)


def near_duplicates(rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: Tables | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows are compared only with equal, non-null labels and equal vector lengths.  Null, empty and
    zero vectors and those with null or non-finite components link with nothing.  Equal vectors
    form a class that is hashed once and counts with its size.  Ties at the threshold link; a null
    id takes part and gets its component's smallest id; repeated rows are vectors of their own;
    other columns are left out; an empty table gives no rows."""
    v = F.col("embedding")
    usable = v.isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    source = source.withColumn("usable", F.coalesce(usable, F.lit(False)))
    keyed = source.withColumns({"node": F.when(F.col("usable"), F.xxhash64("label", "embedding")), "check": F.when(F.col("usable"), F.xxhash64(F.lit(17), "embedding", "label"))})
    for turn in range(8):
        classes = cut(keyed.filter("usable").groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min("check").alias("check"), F.max("check").alias("check_to"), F.first("embedding").alias("embedding"), F.first("label").alias("label")))
        seen = classes.agg(F.count("*"), F.max(F.size("embedding")), F.count_if(F.col("check") != F.col("check_to"))).first()
        if not seen[2]:
            break
        # a few of 10**10 vectors share a 64-bit key with another: they take keys from the second one
        clashing = classes.filter("check != check_to").select(F.col("node").alias("clashing"))
        keyed = keyed.join(clashing, F.col("node") == F.col("clashing"), "left").withColumn("node", F.when(F.col("clashing").isNotNull(), F.xxhash64("check", F.lit(turn))).otherwise(F.col("node"))).drop("clashing")
    else:
        raise RuntimeError("keys of vectors do not settle")
    plan = tables or Tables.of(seen[0], seen[1] or 2)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 1):
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = _vectors(part.column(1))
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    key = buckets(x, plan)
                    own = part.column(2).to_numpy().view(np.uint64) ^ np.uint64(x.shape[1])
                    key = K.mix(key ^ own[:, None, None])
                    node = np.repeat(part.column(0).to_numpy(), key[0].size)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], ["bucket", "node"])

    # read three times below, so written: vectors are hashed once
    posted = cut(classes.select("node", "embedding", F.xxhash64("label")).mapInArrow(K.released_after(hashed), "bucket long, node long"))
    held = posted.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = _in_blocks(join_per_key(posted, held, "bucket"), "bucket").join(classes.select("node", "embedding", "label"), "node")

    def span(table: pa.Table) -> pa.Table:
        """Links that connect the members of a bucket's two blocks as all their links would."""
        x, a, b = _sides(table)
        label = spanning(_linked(x[a], x[b], least), a, b, len(x))
        node = table.column("node").to_numpy()
        own = np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"a": node[own], "b": node[label[own]]})

    links = cut(members.groupBy("bucket", "lo", "hi").applyInArrow(K.released(span), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = cut(components(links))

    def count(table: pa.Table) -> pa.Table:
        x, a, b = _sides(table)
        copies, node = table.column("copies").to_numpy(), table.column("node").to_numpy()
        near = _linked(x[a], x[b], least)
        if a is b or np.array_equal(a, b):
            np.fill_diagonal(near, False)
            return pa.table({"node": node[a], "found": near @ copies[b]})
        return pa.table({"node": np.concatenate([node[a], node[b]]), "found": np.concatenate([near @ copies[b], near.T @ copies[a]])})

    named = roots.join(classes.select("node", "first_id"), "node")
    per_root = named.groupBy("root").agg(F.count("*").alias("n"), F.min("first_id").alias("component_id"))
    placed = cut(join_per_key(named, per_root, "root").select("root", "node", "n", "component_id"))
    compared = _in_blocks(placed, "root").join(classes.select("node", "embedding", "copies"), "node")
    counted = compared.groupBy("root", "lo", "hi").applyInArrow(K.released(count), "node long, found long").groupBy("node").agg(F.sum("found").alias("found"))
    result = (
        classes.select("node", "copies", "first_id")
        .join(placed.select("node", "component_id"), "node", "left")
        .join(counted, "node", "left")
        .select("node", "copies", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component"))
    )
    linked = join_per_key(keyed.filter("usable").select("id", "node"), result, "node", "copies").select("id", "n_links", "component")
    alone = keyed.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).select("id", F.col("n_links").cast("long").alias("n_links"), F.col("component").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
