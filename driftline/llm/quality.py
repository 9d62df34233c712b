"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a short vector of transformed statistics.  Per class,
mean and covariance come from distributed sums (row count, vector sum, sum of
outer products) over all labelled rows of the training fold; nothing is
sampled.  Each covariance is shrunk towards the pooled one and its diagonal,
and factored once by Cholesky.  A score is the posterior of class 1, from the
difference of the two Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import kernels as K
from driftline.llm.common import cut, fold, small_batches

STATISTICS = ("symbols", "upper", "digits", "punctuated", "repeat_1", "repeat_2", "symbol_words", "word_length", "blank", "long_words")
DIM = len(STATISTICS)
#: Pseudo-words (and six times as many pseudo-bytes) with typical rates: short texts stay near the mean.
PRIOR_WORDS = 12.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|!@^~<>=+\\/_{}[]"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:?"]] = True


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text of a slice: square roots of smoothed rates,
    and the logarithm of the smoothed word length.  An empty text gets the prior rates."""
    n = len(off) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[off[1:]] - c[off[:-1]]

    size = (off[1:] - off[:-1]).astype(float)
    start, end, row = K.spans(data, off)
    words = np.bincount(row, minlength=n).astype(float)
    h = K.span_hashes(K.prefix_sums(data), start, end)
    again = np.zeros((2, n))
    for lag in (1, 2):
        same = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        if lag == 2 and len(h) > 2:
            same &= h[2:] != h[1:-1]
        again[lag - 1] = np.bincount(row[lag:][same], minlength=n)
    symbol = _SYMBOL[data]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol, out=sums[1:])
    marked = np.bincount(row[sums[end] > sums[start]], minlength=n)
    length = end - start
    prior_bytes = 6 * PRIOR_WORDS
    rate = lambda count, total, typical, weight: np.sqrt((count + typical * weight) / (total + weight))
    blank = per_row(K.WHITE[data])
    return np.column_stack([
        rate(sums[off[1:]] - sums[off[:-1]], size, 0.0005, prior_bytes),
        rate(per_row(_UPPER[data]), size, 0.02, prior_bytes),
        rate(per_row(_DIGIT[data]), size, 0.002, prior_bytes),
        rate(per_row(_PUNCT[data]), words, 0.15, PRIOR_WORDS),
        rate(again[0], words, 0.001, PRIOR_WORDS),
        rate(again[1], words, 0.005, PRIOR_WORDS),
        rate(marked, words, 0.002, PRIOR_WORDS),
        np.log((size - blank + 5 * PRIOR_WORDS) / (words + PRIOR_WORDS)),
        rate(blank, size, 0.17, prior_bytes),
        rate(np.bincount(row[length > 20], minlength=n), words, 0.02, PRIOR_WORDS),
    ])


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats): one row per input row, null texts as empty ones."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column(1)):
                x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM, dtype=np.int32)), pa.array(x.ravel()))], ["id", "stats"])

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(K.released_after(run), T.StructType([T.StructField("id", id_type), T.StructField("stats", T.ArrayType(T.DoubleType()))]))


def _substitute(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """z with ``lower @ z == right`` for a lower triangular matrix, all columns at once."""
    z = np.empty_like(right)
    for i in range(len(lower)):
        z[i] = (right[i] - lower[i, :i] @ z[:i]) / lower[i, i]
    return z


@dataclass
class Quadratic:
    """Class means, Cholesky factors and constants; index 0 and 1 are the labels."""

    mean: np.ndarray
    chol: np.ndarray
    const: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for each row of x."""
        log = []
        for k in (0, 1):
            z = _substitute(self.chol[k], (x - self.mean[k]).T)
            log.append(self.const[k] - 0.5 * np.einsum("ij,ij->j", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Row count, vector sum and sum of outer products per label, added up on the executors;
    2 * (1 + d + d*d) numbers reach the driver.  ``labelled`` has ``label`` (0/1) and ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            for k in (0, 1):
                own = x[label == k]
                add = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                total[k] = total.get(k, 0) + add
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], ["label", "i", "v"])

    parts = labelled.select("label", "stats").mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v"))
    sums = {k: np.zeros(1 + DIM + DIM * DIM) for k in (0, 1)}
    for r in parts.collect():
        sums[r[0]][r[1]] = r[2]
    return {k: (v[0], v[1 : 1 + DIM], v[1 + DIM :].reshape(DIM, DIM)) for k, v in sums.items()}


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, diagonal: float = 0.05, floor: float = 1e-5) -> Quadratic:
    """Shrinkage: each covariance is mixed with the pooled one (weight ``pooled``, more for a
    class of few rows) and with its own diagonal (``diagonal``); ``floor`` is added to variances.
    A class without rows takes the other one's moments, so scores then follow the smoothed prior."""
    n = {k: sums[k][0] for k in (0, 1)}
    if n[0] + n[1] == 0:
        return Quadratic(np.zeros((2, DIM)), np.stack([np.eye(DIM)] * 2), np.zeros(2))
    mean = {k: sums[k][1] / n[k] if n[k] else sums[1 - k][1] / n[1 - k] for k in (0, 1)}
    scatter = {k: sums[k][2] - n[k] * np.outer(mean[k], mean[k]) if n[k] else np.zeros((DIM, DIM)) for k in (0, 1)}
    common = (scatter[0] + scatter[1]) / (n[0] + n[1])
    chol, const = [], []
    for k in (0, 1):
        weight = min(1.0, pooled + DIM / (DIM + n[k]))
        cov = (1 - weight) * (scatter[k] / n[k] if n[k] else common) + weight * common
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor * np.eye(DIM)
        chol.append(np.linalg.cholesky(cov))
        const.append(-np.log(np.diag(chol[-1])).sum() + np.log((n[k] + 1) / (n[0] + n[1] + 2)))
    return Quadratic(np.stack([mean[0], mean[1]]), np.stack(chol), np.array(const))


def train(features: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int) -> Quadratic:
    """Fit on all labelled rows outside the held-out fold.  Null labels and ids are left out."""
    fold_of = fold(F.col("id"), modulus)
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold_of != held_out))
    return fit(moments(features.filter(fold_of != held_out).join(known, "id")))


def score(features: DataFrame, model: Quadratic, score_col: str = "score") -> DataFrame:
    """(id, score) of each row of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", score_col])

    return features.select("id", "stats").mapInArrow(run, T.StructType([features.schema["id"], T.StructField(score_col, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(id, held_out, score) for every row of ``docs``.

    Statistics are computed once and kept as a narrow table.  Null or empty texts are scored by
    their (prior) statistics; rows with a null id count as held out; repeated rows are scored
    each; an empty table gives no rows, and without any usable label every score is 0.5.  Texts of
    any length are counted whole; no column beside ``doc_id`` and ``text`` is read, so none can clash."""
    features = cut(featurise(docs))
    model = train(features, labels, label_col, modulus, held_out)
    fold_of = fold(F.col("id"), modulus)
    return score(features, model).select("id", F.coalesce(fold_of == held_out, F.lit(True)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", modulus: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns unchanged.

    The model is fitted as in :func:`score_documents`; then each text is scored where it is
    read, so no text is shuffled.  Null and empty texts are judged by their prior statistics.

    The statistics of the training fold are written first.  Where labels are broadcast, one task
    would else compute and add them up in two Python workers at once; workers are lent in turn and
    outlive their tasks, so each executor would hold twice as many for the rest of the session."""
    features = cut(featurise(docs.filter(fold(F.col("doc_id"), modulus) != held_out)))
    model = train(features, labels, label_col, modulus, held_out)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(statistics(data, off)) >= threshold))

    return small_batches(docs).mapInArrow(K.released_after(run), schema)
