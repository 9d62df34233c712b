"""Benchmark decontamination.

For each benchmark item every window of as many words is fingerprinted by
SimHash over its weighted 5-word shingles.  A multi-index of Hamming blocks
finds all items whose fingerprint lies within the radius: the bits fall into
blocks, and each block is probed with all values within a few bits of the
window's own.  As the blocks' bounds add up to the radius less the number of
blocks but one, a fingerprint within the radius is within some block's bound.
Candidates are verified by exact weighted Jaccard similarity of the shingles
(weights: their counts).

A window of similarity s shares at least s/(1+s) of all shingles of the two
with its item, so windows with fewer benchmark shingles are not fingerprinted;
that loses nothing.  A document shorter than an item is a window as a whole.
The index, sorted arrays of bounded bytes, is broadcast; a larger benchmark
takes several passes.  Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm import kernels as K
from driftline.llm.common import small_batches

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 18
#: Bytes of one broadcast index (a longer item alone), and what a word and an item take of it.
INDEX_BYTES = 48 << 20
WORD_BYTES = 20
ITEM_BYTES = 144

#: (first bit, bits, bits that may differ) of each block.
BLOCKS = ((0, 13, 3), (13, 13, 3), (26, 13, 3), (39, 13, 3), (52, 12, 2))
assert sum(bound for _, _, bound in BLOCKS) == RADIUS - len(BLOCKS) + 1

#: Windows that are looked up at a time.
_WINDOWS = 64
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word: a run of letters, digits and multi-byte characters, ASCII-folded."""
    start, end, row = K.spans(data, off, K.NON_WORD)
    return K.span_hashes(K.prefix_sums(data), start, end), row


def _bits(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return (np.unpackbits(shingle.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) << 1) - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhash(shingle: np.ndarray) -> int:
    """Fingerprint of a multiset of shingle hashes; a bit is set where more of them have it."""
    return int(_pack(_bits(shingle).sum(axis=0, keepdims=True))[0])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ."""
    return _POPCOUNT[(a ^ b).view(np.uint16).reshape(len(a), 4)].sum(axis=1)


def _near(bits: int, bound: int) -> np.ndarray:
    """All values of so many bits with at most ``bound`` ones."""
    return np.array([sum(1 << i for i in c) for n in range(bound + 1) for c in combinations(range(bits), n)], np.uint32)


_PROBES = [_near(bits, bound) for _, bits, bound in BLOCKS]


class MultiIndex:
    """Fingerprints in groups, found by Hamming blocks."""

    def __init__(self, prints: np.ndarray, group: np.ndarray) -> None:
        self.prints = prints
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        for first, bits, _ in BLOCKS:
            key = group.astype(np.uint64) << np.uint64(bits) | self._block(prints, first, bits)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.blocks.append((key[order], order))

    @staticmethod
    def _block(prints: np.ndarray, first: int, bits: int) -> np.ndarray:
        return prints >> np.uint64(first) & np.uint64((1 << bits) - 1)

    def near(self, group: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``prints``, place in the index) of all pairs within the radius in a group,
        each once and ascending.

        A block is looked up by its probes, or, where the group has fewer items than there are
        probes, by the items' own values; both find the same."""
        found = [np.zeros(0, np.int64)]
        for (key, order), (first, bits, bound), probes in zip(self.blocks, BLOCKS, _PROBES, strict=True):
            lo, hi = np.searchsorted(key, np.array([group << bits, (group + 1) << bits], np.uint64))
            value, place = key[lo:hi] & np.uint64((1 << bits) - 1), order[lo:hi]
            for at in range(0, len(prints), _WINDOWS):
                own = self._block(prints[at : at + _WINDOWS], first, bits)[:, None]
                if len(value) <= len(probes):
                    window, item = np.nonzero(_POPCOUNT[own ^ value] <= bound)
                else:
                    wanted = (own ^ probes).ravel()
                    start = np.searchsorted(value, wanted, "left")
                    n = np.searchsorted(value, wanted, "right") - start
                    hit = np.flatnonzero(n)
                    n = n[hit]
                    window = np.repeat(hit // len(probes), n)
                    item = np.repeat(start[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(at + window << 32 | place[item])
        pair = np.unique(np.concatenate(found))
        window, item = pair >> 32, pair & 0xFFFFFFFF
        close = distance(prints[window], self.prints[item]) <= RADIUS
        return window[close], item[close]


class Index:
    """Items by word count: their shingles with counts, and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float) -> None:
        self.similarity = similarity
        data, off = K.buffers(pa.array([t for _, t in items], pa.string()))
        word, row = words(data, off)
        ends = np.cumsum(np.bincount(row, minlength=len(items)))
        self.ids: list[object] = []
        sizes, prints, shingles, counts, edges = [], [], [], [], [0]
        for i, (item, _) in enumerate(items):
            own = word[ends[i - 1] if i else 0 : ends[i]]
            if not len(own):
                continue
            shingle, _ = K.shingles(own, np.zeros(len(own), np.int64), 1, SHINGLE)
            self.ids.append(item)
            sizes.append(len(own))
            prints.append(simhash(shingle))
            distinct, count = np.unique(shingle, return_counts=True)
            shingles.append(distinct)
            counts.append(count.astype(np.int32))
            edges.append(edges[-1] + len(distinct))
        self.sizes = np.array(sizes, np.int64)
        self.shingles = np.concatenate([np.zeros(0, np.uint64), *shingles])
        self.counts = np.concatenate([np.zeros(0, np.int32), *counts])
        self.edges = np.array(edges, np.int64)
        #: word counts, ascending; an item's group is its place here
        self.lengths = np.unique(self.sizes)
        self.index = MultiIndex(np.array(prints, np.uint64), np.searchsorted(self.lengths, self.sizes))
        kinds = np.repeat(np.minimum(self.sizes, SHINGLE), np.diff(self.edges))
        self.known = {int(k): np.unique(self.shingles[kinds == k]) for k in np.unique(kinds)}

    def nbytes(self) -> int:
        """Bytes of the arrays."""
        arrays = [self.sizes, self.shingles, self.counts, self.edges, self.index.prints, *self.known.values()]
        return sum(x.nbytes for x in arrays) + sum(k.nbytes + o.nbytes for k, o in self.index.blocks)

    def verify(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity with the sorted shingles of a window."""
        own = self.shingles[self.edges[item] : self.edges[item + 1]]
        count = self.counts[self.edges[item] : self.edges[item + 1]]
        held = np.searchsorted(window, own, "right") - np.searchsorted(window, own, "left")
        both = int(np.minimum(held, count).sum())
        return both / (int(count.sum()) + len(window) - both)

    def matches(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, object, float, int, int]]:
        """(row, item id, similarity, first word, words): the best window of each matching pair."""
        word, row = words(data, off)
        rows = len(off) - 1
        word_ends = np.cumsum(np.bincount(row, minlength=rows))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, known in self.known.items():
            if len(word) < k:
                continue
            shingle, shingle_row = self._runs(word, row, k)
            hit = known[np.minimum(np.searchsorted(known, shingle), len(known) - 1)] == shingle
            lengths = [int(n) for n in self.lengths if min(n, SHINGLE) == k]
            least = min(max(1, math.ceil((n - k + 1) * self.similarity - 1e-9)) for n in lengths)
            hits = np.bincount(shingle_row[hit], minlength=rows)
            bounds = np.searchsorted(shingle_row, np.arange(rows + 1))
            for r in np.flatnonzero(hits >= least).tolist():
                a, b = int(bounds[r]), int(bounds[r + 1])
                first_word = int(word_ends[r - 1]) if r else 0
                self._row(r, shingle[a:b], hit[a:b], k, lengths, best, int(word_ends[r]) - first_word)
        return [(r, self.ids[i], s, at, n) for (r, i), (s, at, n) in sorted(best.items())]

    @staticmethod
    def _runs(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of exactly k words; shorter rows have none here."""
        shingle, shingle_row = K.shingles(word, row, int(row[-1]) + 1, k)
        enough = np.bincount(row)[shingle_row] >= k
        return shingle[enough], shingle_row[enough]

    def _row(self, r: int, shingle: np.ndarray, hit: np.ndarray, k: int, lengths: list[int], best: dict, n_words: int) -> None:
        held = np.concatenate([[0], np.cumsum(hit)])
        sums = None
        for n in lengths:
            size = min(n, n_words) - k + 1  # a row shorter than the item is one window
            need = self.similarity / (1 + self.similarity) * (n - k + 1 + size)
            starts = np.flatnonzero(held[size:] - held[:-size] >= max(1, math.ceil(need - 1e-9)))
            if not len(starts):
                continue
            if sums is None:
                # only the stretches near hits are unpacked: at most one window beyond each
                sums = self._sums(shingle, hit, max(lengths))
            prints = _pack(sums[1][np.searchsorted(sums[0], starts + size)] - sums[1][np.searchsorted(sums[0], starts)])
            window, item = self.index.near(int(np.searchsorted(self.lengths, n)), prints)
            last, sorted_window = -1, shingle[:0]
            for w, i in zip(window.tolist(), item.tolist(), strict=True):
                at = int(starts[w])
                if w != last:
                    last, sorted_window = w, np.sort(shingle[at : at + size])
                s = self.verify(i, sorted_window)
                if s >= self.similarity and s > best.get((r, i), (0.0, 0, 0))[0]:
                    best[r, i] = (s, at, min(n, n_words))

    @staticmethod
    def _sums(shingle: np.ndarray, hit: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, running sums of bit votes before each place), for places near hits."""
        near = np.zeros(len(shingle) + 2, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(near, np.maximum(at - reach, 0), 1)
        np.add.at(near, np.minimum(at + reach, len(shingle)) + 1, -1)
        place = np.flatnonzero(np.cumsum(near)[: len(shingle) + 1] > 0)
        inside = place[place < len(shingle)]
        votes = np.zeros((len(place) + 1, BITS), np.int32)
        np.cumsum(_bits(shingle[inside]), axis=0, out=votes[1 : len(inside) + 1])
        # place p holds the votes of all unpacked shingles before p; stretches are whole windows
        return place, votes[: len(place)]


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, similarity, first_word, n_words): for each document and item that match, the
    best window (the first of equals).

    Null or empty texts and items match nothing; items of fewer than five words match as whole
    sequences; a document shorter than an item is one window; repeated rows of either table give
    repeated rows, and null ids stay null; an empty table gives no rows; other columns are left out.
    Ids keep their types.  A pair of similarity just ``similarity`` can lie beyond the radius (about
    one in 500 at 0.8); no closer one does."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("item_id", item_type), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, similarity, item_col, text_col):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for lo, _, data, off in K.slices(batch.column(1)):
                    found = sent.value.matches(data, off)
                    if found:
                        r, item, s, at, n = zip(*found, strict=True)
                        columns = [batch.column(0).take(pa.array([lo + x for x in r])), *(pa.array(x, f.type) for x, f in zip((item, s, at, n), list(arrow)[1:], strict=True))]
                        yield pa.RecordBatch.from_arrays(columns, arrow.names)

        out = out.union(small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(K.released_after(run), schema))
    return out


def indexes(benchmark: DataFrame, similarity: float = SIMILARITY, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The benchmark's indexes, each of about INDEX_BYTES, made one by one: the driver holds the
    items of one at a time.  They are dealt by a hash, by the words they have."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    held = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10ffff}]+")) * WORD_BYTES + ITEM_BYTES
    total = items.agg(F.sum(held)).first()[0] or 0
    passes = max(1, -(-total // INDEX_BYTES))
    for p in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p).orderBy("item", "text").collect()
        if part:
            yield Index([(r[0], r[1]) for r in part], similarity)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns unchanged; texts are not shuffled."""
    for index in indexes(benchmark, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for lo, hi, data, off in K.slices(batch.column(at)):
                    clean = np.ones(hi - lo, bool)
                    clean[[r for r, *_ in sent.value.matches(data, off)]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))

        docs = small_batches(docs).mapInArrow(K.released_after(run), docs.schema)
    return docs
