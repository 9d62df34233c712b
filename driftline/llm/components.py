"""Connected components of a link table, without leaving the executors.

Alternating large-star and small-star steps (each a shuffle by node) shrink
every component to a star around its smallest node in a number of rounds that
grows with the logarithm of the longest path.  Each round is written to the
shared checkpoint folder, so a lost executor never replays earlier rounds.  The
centre of a large star is dealt to several tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut_at, join_per_key, remove


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", F.least("a", "least").alias("m"), "n")
    return join_per_key(both.filter("b > a"), least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself are tied to the smallest of them.
    ``edges`` have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    kept = least.select(F.col("m").alias("a"), "b")
    moved = join_per_key(edges, least.filter("n > 1"), "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return kept.union(moved).distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; comparable ids).  ``root`` is the
    smallest node of the component.  Repeated and reversed links and self-links are allowed; an
    empty table gives no rows.  ``max_rounds`` only guards against a loop that never ends.  A
    round's table is removed once the next one is written."""
    edges, path = cut_at(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    for _ in range(max_rounds):
        fresh, there = cut_at(_small_star(_large_star(edges)))
        remove(edges.sparkSession, path)
        edges, path = fresh, there
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max(F.when(F.col("a") < F.col("b"), 0).otherwise(1))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def spanning(near: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For a link matrix between the places ``a`` and ``b`` of n members, each member's smallest
    place that its links reach.  Links to these places connect what all links would."""
    label = np.arange(n)
    while True:
        old = label.copy()
        label[a] = np.minimum(label[a], np.where(near, label[b][None, :], n).min(axis=1, initial=n))
        label[b] = np.minimum(label[b], np.where(near, label[a][:, None], n).min(axis=0, initial=n))
        label = label[label]
        if (label == old).all():
            return label
