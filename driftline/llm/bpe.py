"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read once on the driver (its size is bounded by the
vocabulary) and shipped to the workers, so executors need no copy of it.
Texts are encoded whole.  A long text is cut, before encoding, only at places
that no match of the split pattern can span: in front of a white-space
character that follows a visible ASCII character.  Every alternative of the
pattern takes white space only at its front, so ids are those of the uncut
text.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftline.llm import kernels as K
from driftline.llm.common import keep_clashing, small_batches

#: Longer texts are pre-split; the limit is in characters.
SEGMENT_CHARS = 1 << 16
#: Text bytes of one output batch.
OUTPUT_BYTES = 4 << 20

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(rank_bytes: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file's bytes, made once per process."""
    key = (hashlib.sha256(rank_bytes).hexdigest(), pattern)
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_bytes.splitlines()) if token}
        _encodings[key] = tiktoken.Encoding(f"own-{key[0][:8]}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut a text into pieces that encode independently.  Where no safe place is in reach the
    piece grows until one comes, so a text without white space stays whole."""
    at, n = 0, len(text)
    while n - at > limit:
        cut = at + limit
        while cut < n and not (text[cut] in " \n\t" and "!" <= text[cut - 1] <= "~"):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= SEGMENT_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in segments(text):
        ids += enc.encode_ordinary(piece)
    return ids


def _passed(df: DataFrame, text_col: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != text_col]


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + OUTPUT_BYTES, "right")))
        yield at, to
        at = to


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace ``text_col`` by the token ids (array of int) of the whole text; other columns stay,
    one of the name ``ids_col`` with "_input" behind its name.  A null or empty text gives an empty
    array, repeated rows one each, an empty table none; texts of any length are encoded whole.  One
    pass, no shuffle."""
    if ids_col.lower() != text_col.lower():
        df = keep_clashing(df, ids_col)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [f.name for f in _passed(df, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch[text_col]), 0).to_numpy(zero_copy_only=False)
            for at, to in _groups(sizes):
                part = batch.slice(at, to - at)
                ids = [encode_text(enc, x) if x else [] for x in part[text_col].to_pylist()]
                off = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=off[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, count=int(off[-1]))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], [*kept, ids_col])

    return small_batches(df).mapInArrow(K.released_after(run), T.StructType([*_passed(df, text_col), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)]))


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Add the raw bytes (binary) that the ids stand for; null ids give empty bytes.  An id outside
    the vocabulary fails the job.  The bytes are not forced to be valid UTF-8.  Another column of
    the name ``out_col`` stays with "_input" behind its name."""
    if out_col.lower() != ids_col.lower():
        df = keep_clashing(df, out_col)
    elif keep_ids:
        raise ValueError("ids and bytes need two names")
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    fields = [f for f in df.schema.fields if keep_ids or f.name != ids_col]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch[ids_col]), 0).to_numpy(zero_copy_only=False)
            for at, to in _groups(sizes * 4):
                part = batch.slice(at, to - at)
                out = [enc.decode_bytes(x) if x else b"" for x in part[ids_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(out, pa.binary())], [*kept, out_col])

    return small_batches(df).mapInArrow(K.released_after(run), T.StructType([*fields, T.StructField(out_col, T.BinaryType(), False)]))


def encode_decode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``text_col`` replaced by ``ids`` and ``decoded`` in one pass over each batch, as by
    :func:`encode` and :func:`decode`; other columns of these names stay with "_input" behind."""
    df = keep_clashing(df, *(c for c in ("ids", "decoded") if c != text_col.lower()))
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [f.name for f in _passed(df, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch[text_col]), 0).to_numpy(zero_copy_only=False)
            for at, to in _groups(sizes):
                part = batch.slice(at, to - at)
                ids = [encode_text(enc, x) if x else [] for x in part[text_col].to_pylist()]
                off = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=off[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, count=int(off[-1]))
                out = [enc.decode_bytes(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(out, pa.binary())], [*kept, "ids", "decoded"])

    schema = [*_passed(df, text_col), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)]
    return small_batches(df).mapInArrow(K.released_after(run), T.StructType(schema))
