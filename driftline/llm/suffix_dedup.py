"""Exact substring dedup with a distributed, partial suffix array.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.  Only suffixes that can matter are sorted:

1. Every string of LENGTH bytes has an anchor: of its GRAM-byte grams the one
   with the least hash (the leftmost on ties).  Equal strings have equal
   anchors at equal offsets, so they meet under the anchor's hash.
2. Documents are dealt into buckets of bounded bytes by a hash of their text,
   so copies meet and count once; a text whose copies would overfill a bucket
   is salted.  A bucket sends its distinct anchor hashes, in binary blocks by
   hash range, and learns which occur in other documents too.
3. For those it sends the context (the bytes of the strings that have the
   anchor), once per distinct context, with the smallest document id.
4. Per hash range, the suffixes that start in these contexts are ordered by
   deep-shallow sorting to the depth LENGTH: multikey quicksort, eight bytes a
   step, to a shallow depth; then blind tries for the groups that still agree.
   Neighbours of equal suffixes share the smallest document id among them.
5. Each bucket gets its verdicts back and cuts its texts.

Around a passage that a third of all documents hold, every document's bytes
differ, so its anchors would gather a context of each document.  The strings
of an anchor that many buckets hold therefore meet, four offsets at a time,
under a hash of the 47 bytes these strings share: strings with bytes of their
own scatter, and those inside the passage cost a few contexts per bucket.
Nothing forms pairs.  Texts are shuffled once, by bucket (the
exchange is reused); all else are blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm import buckets as B
from driftline.llm import kernels as K

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM  # bytes of a string beside its anchor
CONTEXT = LENGTH + SPAN
#: Buckets that hold an anchor hash, from which on its strings meet in smaller groups.  It bounds an
#: anchor's contexts to those of so many buckets.
MANY_BUCKETS = 256
#: Strings of neighbouring offsets that then stay together; they share all but so many bytes.
TOGETHER = 4
#: Bytes to which multikey quicksort goes before blind tries take over.
SHALLOW = 24
#: Suffixes sorted at a time (a larger group of one anchor stays whole).
SORT_BLOCK = 200_000

U64 = np.uint64
_FULL = U64(1 << 63)
#: Bits of an anchor hash that are sent: enough to meet by, as contexts are compared in full.
_HASH = U64(0xFFFFFFFFFFFF0000)


# --- deep-shallow sorting -------------------------------------------------


def _word(buffer: np.ndarray, at: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The bytes depth..depth+8 of each suffix as a big-endian number; none beyond ``length``."""
    n = min(8, length - depth)
    out = np.zeros(len(at), U64)
    for i in range(n):
        out = out << U64(8) | buffer[at + (depth + i)]
    return out


def multikey_quicksort(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes by (group, first ``depth`` bytes); returns the order and the new group of
    each place.  Only groups of two or more take part in a further step."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    for d in range(0, depth, 8):
        start = B.runs(g)
        size = np.diff(np.append(start, len(g)))
        open_ = np.repeat(size > 1, size)
        where = np.flatnonzero(open_)
        if not len(where):
            break
        own = order[where]
        w = _word(buffer, at[own], d, min(length, depth))
        by = np.lexsort((w, g[where]))
        order[where] = own[by]
        w = w[by]
        gw = g[where]
        split = np.concatenate([[True], (gw[1:] != gw[:-1]) | (w[1:] != w[:-1])])
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        new[where] |= split
        g = np.cumsum(new) - 1
    return order, g


def blind_tries(buffer: np.ndarray, at: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Finish the order inside groups that agree on ``depth`` bytes; equal suffixes end in one group.

    One trie per group, all grown at once: each round enters one leaf per open branch and compares
    every other suffix of the branch with that leaf alone.  The first differing byte tells where it
    leaves the leaf's path and into which branch it falls; suffixes that reach the leaf's end are
    equal to it.  Branches before, at and behind the leaf are laid out in byte order."""
    while True:
        start = B.runs(group)
        size = np.diff(np.append(start, len(group)))
        todo = size > 1
        if not todo.any():
            return order, group
        where = np.flatnonzero(np.repeat(todo, size))
        own, gw = order[where], group[where]
        leaf = np.repeat(order[start[todo]], size[todo])
        lcp = np.full(len(own), length, np.int16)
        mine, leafs = np.zeros(len(own), np.uint8), np.zeros(len(own), np.uint8)
        alive = np.arange(len(own))
        for d in range(depth, length, 8):
            a, b = _word(buffer, at[own[alive]], d, length), _word(buffer, at[leaf[alive]], d, length)
            x = a ^ b
            differs = np.flatnonzero(x)
            if len(differs):
                n = min(8, length - d)
                xs = x[differs]
                byte = np.zeros(len(xs), np.int64)
                for i in range(1, n):
                    byte += xs < (U64(1) << U64(8 * (n - i)))
                shift = (8 * (n - 1 - byte)).astype(U64)
                idx = alive[differs]
                lcp[idx] = d + byte
                mine[idx] = (a[differs] >> shift & U64(255)).astype(np.uint8)
                leafs[idx] = (b[differs] >> shift & U64(255)).astype(np.uint8)
            alive = alive[x == 0]
            if not len(alive):
                break
        side = np.where(lcp == length, 0, np.where(mine < leafs, -1, 1)).astype(np.int64)
        near = np.where(side < 0, lcp, -lcp).astype(np.int64)  # in front: early leavers first; behind: last
        branch = (side + 1) << 32 | (near + 256) << 16 | mine
        by = np.lexsort((branch, gw))
        order[where] = own[by]
        key, gs = branch[by], gw[by]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        new[where] |= np.concatenate([[True], (gs[1:] != gs[:-1]) | (key[1:] != key[:-1])])
        done = np.zeros(len(group), bool)
        done[where] = side[by] == 0
        group = np.cumsum(new) - 1
        if done.any():  # what ends at a leaf is settled: take it out of further rounds
            rest = np.flatnonzero(~done)
            if not len(rest):
                return order, group
            sub_order, sub_group = blind_tries(buffer, at, order[rest], group[rest], depth, length)
            order[rest] = sub_order
            fresh = np.ones(len(group), bool)
            fresh[1:] = group[1:] != group[:-1]
            inner = np.ones(len(rest), bool)
            inner[1:] = sub_group[1:] != sub_group[:-1]
            fresh[rest] |= inner
            return order, np.cumsum(fresh) - 1


def deep_shallow_sort(buffer: np.ndarray, at: np.ndarray, length: int, group: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of ``buffer`` that start at ``at``, cut to ``length`` bytes.

    Returns the order (a permutation of ``at``) and, for each place in it, a number that equal
    suffixes share.  ``group`` may state a first key to sort by, such as a bucket."""
    if group is None:
        group = np.zeros(len(at), np.int64)
    order, g = multikey_quicksort(buffer, at, group, min(shallow, length), length)
    return blind_tries(buffer, at, order, g, min(shallow, length), length)


# --- anchors and contexts -------------------------------------------------


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, row, first string, last string) of each anchor of a slice; strings are
    given by their starts, and every string within a row belongs to exactly one anchor."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, U64), z, z, z, z
    raw = np.ascontiguousarray(data)
    load = lambda shift: np.ndarray((n - GRAM + 1,), "<u8", raw, shift, (1,)).astype(U64)
    h = load(0) * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h += load(8)
    h = K.mix(h)
    low = (h & ~U64(0xFFFFFFFF)) | np.arange(len(h), dtype=U64)
    reach = 1
    while reach * 2 <= SPAN + 1:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    more = SPAN + 1 - reach
    if more:
        low = np.minimum(low[:-more], low[more:])
    valid = np.zeros(len(low), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            valid[a : b - LENGTH + 1] = True
    string = np.flatnonzero(valid)
    at = (low[string] & U64(0xFFFFFFFF)).astype(np.int64)
    first = B.runs(at)
    last = np.append(first[1:], len(at)) - 1
    position = at[first] if len(at) else z
    # anchors are least hashes, so they crowd near zero: mix once more, that hash ranges get equal shares
    return K.mix(h[position] ^ U64(0xD1B54A32D192ED03)), position, np.searchsorted(off, position, "right") - 1, string[first], string[last]


def contexts(data: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The bytes of the strings first..last of each anchor, at fixed places around its gram, and
    zeros elsewhere."""
    padded = np.concatenate([np.zeros(SPAN, np.uint8), data, np.zeros(SPAN, np.uint8)])
    column = np.arange(CONTEXT, dtype=np.int16)
    out = np.empty((len(position), CONTEXT), np.uint8)
    for lo in range(0, len(position), 8192):
        part = slice(lo, lo + 8192)
        begin = (SPAN - (position[part] - first[part])).astype(np.int16)[:, None]
        end = (SPAN + LENGTH - (position[part] - last[part])).astype(np.int16)[:, None]
        out[part] = padded[position[part, None] + column] * ((column >= begin) & (column < end))
    return out


def _scatter(data: np.ndarray, h: np.ndarray, position: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of many buckets, split into runs of TOGETHER offsets that meet under a hash of the
    bytes which all strings of the run share; the other anchors as they are."""
    at = np.flatnonzero(often)
    low, high = (position - last)[at] // TOGETHER, (position - first)[at] // TOGETHER
    n = high - low + 1
    of = np.repeat(at, n)
    run = np.repeat(low, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    begin = position[of] - TOGETHER * run
    core = K.span_hashes(K.prefix_sums(data, K.BYTES), begin, begin + LENGTH - TOGETHER + 1)
    own = K.mix(core ^ h[of] ^ run.astype(U64)) & _HASH
    rest = np.flatnonzero(~often)
    join = lambda a, b: np.concatenate([a[rest], b])
    return join(h, own), join(position, position[of]), join(row, row[of]), join(first, np.maximum(first[of], begin - TOGETHER + 1)), join(last, np.minimum(last[of], begin))


def _context_key(ctx: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low.astype(U64) << U64(8) | high
    words = np.ascontiguousarray(np.pad(ctx, ((0, 0), (0, -CONTEXT % 8)))).view("<u8")
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(31)
    return K.mix(h)


_ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("id", "<i8"), ("low", "u1"), ("high", "u1"), ("ctx", "u1", (CONTEXT,))])


def _same_entry(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which neighbours have equal keys; equal keys of different contexts fail the job."""
    same = (a["h"] == b["h"]) & (a["c"] == b["c"])
    if (a["ctx"][same] != b["ctx"][same]).any() or (a["low"][same] != b["low"][same]).any() or (a["high"][same] != b["high"][same]).any():
        raise RuntimeError("two contexts have one 64-bit key; use another seed")
    return same


class _Bucket(B.Bucket):
    """A bucket with its contexts."""

    def shared(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries, entry of each occurrence, occurrences): distinct contexts whose anchor hash is
        among ``known`` (sorted; a low bit marks hashes of many buckets), ascending by key;
        occurrences are (text, position, first, last)."""
        entries, where = [], []
        for lo, _, data, off in self.slices():
            h, position, row, first, last = anchors(data, off)
            hashes = known & _HASH
            if len(known):
                place = np.minimum(np.searchsorted(hashes, h & _HASH), len(known) - 1)
                hit = np.flatnonzero(hashes[place] == h & _HASH)
                often = known[place[hit]] & ~_HASH != 0
            else:
                hit, often = np.zeros(0, np.int64), np.zeros(0, bool)
            h, position, row, first, last = h[hit] & _HASH, position[hit], row[hit], first[hit], last[hit]
            if often.any():
                h, position, row, first, last = _scatter(data, h, position, row, first, last, often)
            e = np.zeros(len(h), _ENTRY)
            e["ctx"] = contexts(data, position, first, last)
            e["low"], e["high"] = position - last, position - first
            e["h"], e["c"] = h, _context_key(e["ctx"], e["low"], e["high"])
            e["id"] = self.text_id[lo + row]
            entries.append(e)
            where.append(np.column_stack([lo + row, position - off[row], first - off[row], last - off[row]]))
        if not entries:
            return np.zeros(0, _ENTRY), np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        e, w = np.concatenate(entries), np.concatenate(where)
        del entries, where
        by = np.lexsort((e["c"], e["h"]))
        e, w = e[by], w[by]
        new = np.ones(len(e), bool)
        if len(e) > 1:
            new[1:] = ~_same_entry(e[1:], e[:-1])
        own = np.cumsum(new) - 1
        out = e[new]
        if len(out):
            out["id"] = np.minimum.reduceat(e["id"], np.flatnonzero(new))
        self.occurrence_ids = e["id"]
        return out, own, w


def verdicts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts ordered by (h, c), as sent by all buckets of a hash range: the smallest id that
    has the same context, and the strings (a bit per offset) that some other context with a still
    smaller id has too."""
    n = len(entries)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = ~_same_entry(entries[1:], entries[:-1])
    own, start = np.cumsum(new) - 1, np.flatnonzero(new)
    distinct = entries[start]
    least = np.minimum.reduceat(entries["id"], start)
    group = np.cumsum(np.concatenate([[True], distinct["h"][1:] != distinct["h"][:-1]])) - 1
    mask = np.zeros(len(distinct), U64)
    crowd = np.bincount(group)[group] > 1  # an anchor with one context has nothing to order
    count = np.where(crowd, distinct["high"].astype(np.int64) - distinct["low"] + 1, 0)
    total = np.cumsum(count)
    lo = 0
    edges = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(distinct))
    while lo < len(distinct):
        limit = (total[lo - 1] if lo else 0) + SORT_BLOCK
        hi = int(edges[np.searchsorted(edges, max(lo + 1, int(np.searchsorted(total, limit, "right"))), "left")])
        c = count[lo:hi]
        ctx = np.repeat(np.arange(lo, hi), c)
        if len(ctx):
            offset = np.arange(len(ctx)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(distinct["low"][lo:hi].astype(np.int64), c)
            buffer = np.ascontiguousarray(distinct["ctx"][lo:hi]).ravel()
            at = (ctx - lo) * CONTEXT + SPAN - offset
            order, same = deep_shallow_sort(buffer, at, LENGTH, group[ctx] * (SPAN + 1) + offset)
            first = B.runs(same)
            size = np.diff(np.append(first, len(same)))
            smallest = np.repeat(np.minimum.reduceat(least[ctx[order]], first), size)
            hit = smallest < least[ctx[order]]
            np.bitwise_or.at(mask, ctx[order][hit], U64(1) << offset[order][hit].astype(U64))
        lo = hi
    return least[own], mask[own]


def _cut(bucket: _Bucket, entries: np.ndarray, own: np.ndarray, where: np.ndarray, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct text of the bucket, covered bytes as a mask over the texts put end to end."""
    size = bucket.off[bucket.rows + 1] - bucket.off[bucket.rows]
    base = np.concatenate([[0], np.cumsum(size)])
    step = np.zeros(int(base[-1]) + 1, np.int32)
    v = verdict[own]
    full = (bucket.occurrence_ids > entries["id"][own]) | (v & _FULL != 0)
    at = base[where[:, 0]]
    np.add.at(step, at[full] + where[full, 2], 1)
    np.add.at(step, at[full] + where[full, 3] + LENGTH, -1)
    part = np.flatnonzero(~full & (v != 0))
    for offset in range(SPAN + 1):
        some = part[(v[part] >> U64(offset)) & U64(1) != 0]
        begin = at[some] + where[some, 1] - offset
        np.add.at(step, begin, 1)
        np.add.at(step, begin + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0, base


def whole_characters(text: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """``covered`` without the bytes of characters that are covered in part only."""
    if not covered.any():
        return covered
    first = (text & 0xC0) != 0x80
    char = np.cumsum(first)
    size = np.bincount(char)
    return np.bincount(char, covered)[char] == size[char]


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """``docs`` with the text cut to its kept characters; other columns as they are.  A null text
    becomes empty.  Null and repeated ids, and empty tables, as in :func:`dedup`."""
    return _plan(docs, id_col, text_col, bucket_bytes, MANY_BUCKETS, False)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = B.BUCKET_BYTES, many_buckets: int = MANY_BUCKETS) -> DataFrame:
    """(id, n_bytes, spans, kept): the removed byte spans, maximal and ascending, and the kept bytes;
    other columns are left out.

    Ids are whole numbers, others are refused (TypeError).  A null text is empty.  A null id counts as larger than every id and as equal to other nulls;
    rows with one id never cut each other.  An empty table gives no rows."""
    return _plan(docs, id_col, text_col, bucket_bytes, many_buckets, True)


def _plan(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, many_buckets: int, spans_wanted: bool) -> DataFrame:
    source, buckets, total = B.deal(docs, id_col, text_col, bucket_bytes, passed=not spans_wanted)
    parts, context_parts = B.parts_for(total, SPAN // 2), buckets
    passed = [f for f in docs.schema.fields if not spans_wanted and f.name not in (id_col, text_col)]

    def send_hashes(table: pa.Table) -> pa.Table:
        bucket = _Bucket(table)
        seen = []
        for lo, _, data, off in bucket.slices():
            h, _, row, _, _ = anchors(data, off)
            by = np.lexsort((row, h & _HASH))
            h, row = h[by] & _HASH, row[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            seen.append(h[new])
        h, count = np.unique(np.concatenate([np.zeros(0, U64), *seen]), return_counts=True)
        return B.blocks(h, h | (count > 1).astype(U64) << U64(15), parts, table.column("bucket")[0].as_py(), B.pack_sorted)

    def meet(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        h = np.concatenate([B.unpack_sorted(b) for b in table.column("block").to_pylist()])
        plain = h & _HASH
        by = np.argsort(plain, kind="stable")
        start = B.runs(plain[by])
        size = np.diff(np.append(start, len(by)))
        wanted = np.repeat((size > 1) | (np.bitwise_or.reduceat(h[by], start) & ~_HASH != 0), size)
        take = np.zeros(len(h), bool)
        take[by[wanted]] = True
        often = np.zeros(len(h), U64)
        often[by] = np.repeat((size >= many_buckets).astype(U64) << U64(15), size)
        plain = plain | often
        rows = [plain[a:b][take[a:b]] for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)]
        return pa.table([table.column("part").combine_chunks(), table.column("bucket").combine_chunks(), pa.array([len(r) for r in rows], pa.int32()), pa.array([B.pack_sorted(r) for r in rows], pa.binary())], schema=B.SENT)

    def known_of(table: pa.Table) -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, U64), *(B.unpack_sorted(b) for b in table.column("block").to_pylist())]))

    def send_contexts(texts: pa.Table, hashes: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return B.SENT.empty_table()
        entries, _, _ = _Bucket(texts).shared(known_of(hashes))
        return B.blocks(entries["h"], entries, context_parts, texts.column("bucket")[0].as_py(), lambda e: B.pack(e.tobytes()))

    def judge(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        entries = np.concatenate([np.frombuffer(B.unpack(b, n * _ENTRY.itemsize), _ENTRY) for b, n in zip(table.column("block").to_pylist(), sizes.tolist(), strict=True)])
        by = np.lexsort((entries["c"], entries["h"]))
        ids = entries["id"].copy()
        entries = entries[by]
        least, mask = verdicts(entries)
        out = np.empty(len(by), U64)
        out[by] = np.where(least < ids[by], _FULL, mask)
        rows = [out[a:b].tobytes() for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)]
        return pa.table([table.column("part").combine_chunks(), table.column("bucket").combine_chunks(), table.column("n").combine_chunks(), pa.array([B.pack(r) for r in rows], pa.binary())], schema=B.SENT)

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    if spans_wanted:
        result = T.StructType.fromDDL("id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    else:
        result = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(f"passed_{i}", f.dataType) for i, f in enumerate(passed))])
    arrow_result = to_arrow_schema(result)

    def cut_texts(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return arrow_result.empty_table()
        bucket = _Bucket(texts)
        answered = replies.column("answered").to_numpy(zero_copy_only=False)
        known = known_of(replies.filter(pa.array(~answered)))
        entries, own, where = bucket.shared(known)
        back = replies.filter(pa.array(answered)).sort_by("part")
        verdict = np.frombuffer(b"".join(B.unpack(b, 8 * n) for b, n in zip(back.column("block").to_pylist(), back.column("n").to_pylist(), strict=True)), U64)
        covered, base = _cut(bucket, entries, own, where, verdict)
        spans, kept = [], []
        for k in range(len(bucket.rows)):
            r = bucket.rows[k]
            c = covered[base[k] : base[k + 1]]
            text = bucket.data[bucket.off[r] : bucket.off[r + 1]]
            if not spans_wanted:
                c = whole_characters(text, c)
            step = np.diff(np.concatenate([[0], c.astype(np.int8), [0]]))
            spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)])
            kept.append(text[~c].tobytes())
        n = bucket.off[1:] - bucket.off[:-1]
        out_spans, out_kept = [], []
        for i, k in enumerate(bucket.text_of.tolist()):
            again = bucket.ids[i] > bucket.text_id[k] and n[i] >= LENGTH
            out_spans.append([{"start": 0, "end": int(n[i])}] if again else spans[k])
            out_kept.append(b"" if again else kept[k])
        if not spans_wanted:
            return pa.table([bucket.id_column, pa.array(out_kept, pa.binary()).cast(pa.string()), *(texts.column(f"passed_{i}") for i in range(len(passed)))], names=result.names)
        return pa.table([bucket.id_column, pa.array(n), pa.array(out_spans, span_type), pa.array(out_kept, pa.binary())], names=result.names)

    by_bucket = source.groupBy("bucket")
    met = by_bucket.applyInArrow(K.released(send_hashes), B.SENT_DDL).groupBy("part").applyInArrow(K.released(meet), B.SENT_DDL)
    known = met.filter("n > 0")
    judged = by_bucket.cogroup(known.groupBy("bucket")).applyInArrow(K.released(send_contexts), B.SENT_DDL).groupBy("part").applyInArrow(K.released(judge), B.SENT_DDL)
    replies = known.withColumn("answered", F.lit(False)).unionByName(judged.withColumn("answered", F.lit(True)))
    out = by_bucket.cogroup(replies.groupBy("bucket")).applyInArrow(K.released(cut_texts), result)
    if spans_wanted:
        return out
    back = {id_col: F.col("id").cast(docs.schema[id_col].dataType), text_col: F.col("text")} | {f.name: F.col(f"passed_{i}") for i, f in enumerate(passed)}
    return out.select(*(back[c].alias(c) for c in docs.columns))
