"""Toxicity: a factorization machine over hashed terms.

Terms are the folded words of a text, their leading letters and their counts
of presence, hashed into a fixed space.  The score is the logistic of
w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the distinct terms, so
pairs of terms carry weight of their own.  The model is fitted on a bounded,
documented sample of labelled rows (``MAX_TRAINING_ROWS``); scoring reads the
whole of every text and costs time linear in its terms.
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
from driftline.llm.common import cut_at, fold, remove, small_batches

#: Hashed term space (a power of two).
BITS = 20
#: Lengths, in bytes, of the leading parts that count as terms beside the whole word.
LEADING = (4, 5, 6)
FACTORS = 4
#: Bound of the training sample, in rows; below it every labelled row is used.
MAX_TRAINING_ROWS = 40_000
#: Terms in fewer distinct training texts get no weight.
MIN_ROWS = 4
#: Terms enter the model if their share among toxic and other texts differs by so many standard errors.
MIN_Z = 5.0
#: Bound of the model, in terms; of more, those that differ most stay.
MAX_TERMS = 4096


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of every word and leading part of a slice, with repeats, ordered by kind then
    position.  Words are runs of letters, digits and multi-byte characters, ASCII-folded."""
    start, end, row = K.spans(data, off, K.NON_WORD)
    sums = K.prefix_sums(data)
    out, rows = [K.span_hashes(sums, start, end)], [row]
    for n in LEADING:
        has = end - start >= n
        out.append(K.mix(K.span_hashes(sums, start[has], start[has] + n) ^ np.uint64(n)))
        rows.append(row[has])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(rows)


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, terms): the sorted distinct hashed terms of each row."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column(1)):
                term, row = terms(data, off)
                key = np.unique(row.astype(np.int64) << BITS | term)
                count = np.bincount(key >> BITS, minlength=hi - lo)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))], ["id", "terms"])

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(K.released_after(run), T.StructType([T.StructField("id", id_type), T.StructField("terms", T.ArrayType(T.IntegerType()))]))


@dataclass
class FactorizationMachine:
    bias: float
    term: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def lookup(self) -> np.ndarray:
        """For each hashed term its place in ``weight``, or -1."""
        at = np.full(1 << BITS, -1, np.int32)
        at[self.term] = np.arange(len(self.term), dtype=np.int32)
        return at

    def score(self, place: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """``place`` and ``row``: each row's distinct known terms."""
        z = self.bias + np.bincount(row, self.weight[place], rows)
        for f in range(self.factor.shape[1]):
            v = self.factor[place, f]
            z += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def telling(counts: np.ndarray, hits: np.ndarray, n: int, positive: float) -> np.ndarray:
    """The terms that pass a two-proportion test between the classes, in order.  ``counts`` and
    ``hits``: in how many of the ``n`` rows, and of the ``positive`` ones, each term stands."""
    p1, p0, p = hits / positive, (counts - hits) / (n - positive), counts / n
    z = np.abs((p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / positive + 1 / (n - positive))))
    passed = np.flatnonzero((counts >= MIN_ROWS) & (z >= MIN_Z))
    return np.sort(passed[np.argsort(-z[passed], kind="stable")[:MAX_TERMS]]).astype(np.int32)


def tally(term: np.ndarray, end: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, hits) of each term; a row's terms are distinct."""
    hit = np.repeat(label == 1, np.diff(end, prepend=0))
    return np.bincount(term, minlength=1 << BITS), np.bincount(term[hit], minlength=1 << BITS)


def fit(term: np.ndarray, end: np.ndarray, label: np.ndarray, known: np.ndarray | None = None, steps: int = 2000, rate: float = 0.2, l2: float = 1e-3, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss with classes weighted evenly, over the ``known`` terms (by
    default the :func:`telling` ones); at least ``steps`` steps of about 128 rows, and 20 passes.
    ``end``: where each row's terms end."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n, positive = len(label), float(label.sum())
    if positive in (0, n):
        share = (positive + 1) / (n + 2)
        return FactorizationMachine(float(np.log(share / (1 - share))), term[:0], np.zeros(0), np.zeros((0, FACTORS)))
    if known is None:
        known = telling(*tally(term, end, label), n, positive)
    at_known = np.full(1 << BITS, -1, np.int64)
    at_known[known] = np.arange(len(known))
    keep = np.flatnonzero(at_known[term] >= 0)
    row, place = np.searchsorted(end, keep, "right"), at_known[term[keep]]
    d = len(known)
    w, v, bias = np.zeros(d), rng.normal(0, 0.01, (d, FACTORS)), 0.0
    gw, gv, gb = np.full(d, 1e-2), np.full((d, FACTORS), 1e-2), 1e-2
    cost = np.where(label == 1, max(1.0, n / positive / 2), 1.0)
    first = np.searchsorted(row, np.arange(n + 1))
    blocks = max(1, n // 128)
    for _ in range(max(20, -(-steps // blocks))):
        for block in np.array_split(rng.permutation(n), blocks):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in block])
            p, r = place[at], np.repeat(np.arange(len(block)), first[block + 1] - first[block])
            vp = v[p]
            per_row = lambda x: np.stack([np.bincount(r, x[:, f], len(block)) for f in range(FACTORS)], 1)  # noqa: E731, B023
            sums = per_row(vp)
            z = bias + np.bincount(r, w[p], len(block)) + 0.5 * (sums**2 - per_row(vp**2)).sum(1)
            g = cost[block] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[block]) / len(block)
            down = g.sum()
            gb += down**2
            bias -= rate * down / np.sqrt(gb)
            hit, inverse = np.unique(p, return_inverse=True)
            dw = np.bincount(inverse, g[r], len(hit)) + l2 * w[hit] / len(block)
            gw[hit] += dw**2
            w[hit] -= rate * dw / np.sqrt(gw[hit])
            pull = g[r, None] * (sums[r] - vp)
            dv = np.stack([np.bincount(inverse, pull[:, f], len(hit)) for f in range(FACTORS)], 1) + l2 * v[hit]
            gv[hit] += dv**2
            v[hit] -= 0.2 * rate * dv / np.sqrt(gv[hit])
    return FactorizationMachine(float(bias), known, w, v)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(terms, end of each row's) of a column of lists."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(lists):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))


def count_terms(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """:func:`tally` of rows (label, terms), added up on the executors; at most 2**BITS rows of
    three numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hits = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            more = tally(*_flat(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False))
            counts += more[0]
            hits += more[1]
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen]), pa.array(hits[seen])], ["term", "n", "hits"])

    parts = small_batches(rows).select("label", "terms").mapInArrow(K.released_after(run), "term int, n long, hits long")
    got = parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter(F.col("n") >= MIN_ROWS).toArrow()
    counts, hits = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    counts[got.column("term").to_numpy()] = got.column("n").to_numpy()
    hits[got.column("term").to_numpy()] = got.column("hits").to_numpy()
    return counts, hits


def _only(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """Rows (key, label, terms) with none but the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_known = np.zeros(1 << BITS, bool)
        is_known[known] = True
        for batch in batches:
            term, end = _flat(batch.column(2))
            keep = is_known[term]
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], end])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(term[keep]))], ["key", "label", "terms"])

    return small_batches(rows).select("key", "label", "terms").mapInArrow(K.released_after(run), "key long, label int, terms array<int>")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """(label, text) of about ``max_rows`` labelled rows outside the held-out fold, or all of fewer.
    A hash of the id picks the labels, so what is broadcast has that bound, and texts without a
    picked label are left where they are read; where an id has many texts, a hash picks among them."""
    share = lambda n: int((1 << 20) * min(1.0, max_rows / max(n, 1)))
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold(F.col("id"), modulus) != held_out)).distinct()
    picked = F.broadcast(known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share(known.count())))
    found = docs.select("doc_id").join(picked, F.col("doc_id") == F.col("id")).count()
    texts = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < share(found))
    return texts.join(picked, F.col("doc_id") == F.col("id")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, max_rows: int = MAX_TRAINING_ROWS) -> FactorizationMachine:
    """Fit on the :func:`sample` of labelled rows.  Terms are tested on the executors; the driver
    receives of each row only those that passed, so at most ``max_rows`` times MAX_TERMS small
    numbers whatever the length of the texts."""
    featured = featurise(sample(docs, labels, label_col, modulus, held_out, max_rows), "label")
    # copies of a text would make its chance words look telling, so they count once
    rows, path = cut_at(featured.select(F.xxhash64("terms").alias("key"), F.col("id").alias("label"), "terms").dropDuplicates(["key", "label"]))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    known = telling(*count_terms(rows), n, positive) if 0 < positive < n else np.zeros(0, np.int32)
    got = _only(rows, known).orderBy("key", "label").select("terms", "label").toArrow()
    remove(docs.sparkSession, path)
    return fit(*_flat(got.column("terms")), got.column("label").to_numpy().astype(float), known)


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 3, held_out: int = 1, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(id, held_out, score) for every row of ``docs``.

    Null and empty texts have no terms and score by the bias alone.  Rows with a null id count as
    held out; repeated rows are scored each; an empty table gives no rows, and without labels of
    both kinds the score is their smoothed share.  Texts of any length are scored whole, where they
    are read; no column beside ``doc_id`` and ``text`` is read, so none can clash."""
    model = train(docs, labels, label_col, modulus, held_out, max_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = sent.value
        at = fm.lookup()
        for batch in batches:
            for lo, hi, data, off in K.slices(batch.column(1)):
                term, row = terms(data, off)
                place = at[term]
                hit = place >= 0
                key = np.unique(row[hit].astype(np.int64) << 32 | place[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fm.score(key & 0xFFFFFFFF, key >> 32, hi - lo))], ["id", "score"])

    scored = small_batches(docs).select(F.col("doc_id").alias("id"), "text").mapInArrow(K.released_after(run), T.StructType([T.StructField("id", id_type), T.StructField("score", T.DoubleType())]))
    return scored.select("id", F.coalesce(fold(F.col("id"), modulus) == held_out, F.lit(True)).alias("held_out"), "score")
