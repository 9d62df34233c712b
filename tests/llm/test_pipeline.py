import base64
import re
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import tiktoken

from driftline.llm import quality, suffix_dedup
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_ngram_join import shingles
from tests.llm.test_rest import windows
from tests.llm.test_suffix_dedup import brute as cuts

DATA = "/root/testdata/sf0.001"


def test_stage_list_and_columns(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "suffix_dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rule = P.ngram_join.Rule(5, 80, 100)
    kept = {r.doc_id for r in P.near_duplicate_stage(spark, docs, DATA).collect()}
    assert kept == {i for i, _, c in groups(rows, rule) if i == c}

    small = [r for r in rows if len(r[1]) < 1500]
    frame = docs.filter("length(text) < 1500")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.suffix_stage(spark, frame, DATA).collect()}
    for i, _, spans, _ in cuts(small):
        b = dict(small)[i].encode()
        whole = bytearray()
        for c, at in _characters(b):
            if not any(s <= at and at + len(c) <= e for s, e in spans):
                whole += c
        assert got[i] == (whole.decode(), len(whole.decode()))

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in P.encoding_stage(spark, docs, DATA).collect():
        assert r.ids == plain.encode_ordinary(dict(rows)[r.doc_id]) and r.n_tokens == len(r.ids)


def _characters(b):
    at = 0
    for c in b.decode():
        e = c.encode()
        yield e, at
        at += len(e)


def test_run_applies_all_stages(spark):
    out = P.run(spark, DATA)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < 200
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r.doc_id for r in quality.keep_good(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert set(ids) <= good


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (None, "some words " * 30, None, None, None), (2, "", "en", "s", 0), (3, "x" * 3000, "en", "s", 3000), (3, "x" * 3000, "en", "s", 3000), (4, "some words " * 30, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        out = stage(spark, docs, DATA).collect()
        assert len(out) <= len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    left = Counter(r.doc_id for r in P.near_duplicate_stage(spark, docs, DATA).collect())
    assert left == Counter({1: 1, None: 1, 2: 1, 3: 2, 4: 1})
    assert {r.doc_id: r.text for r in suffix_dedup.dedup_texts(docs).collect()}[None] == ""


def test_near_copies_go_by_row(spark, prose):
    copied, clean, third = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, copied), (2, copied + " more"), (2, clean), (3, third + " a"), (3, third + " b"), (3, third + " b"), (4, clean), (4, None), (None, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = Counter((r.doc_id, r.text) for r in P.near_duplicate_stage(spark, docs, DATA).collect())
    third_left = {t: n for (i, t), n in left.items() if i == 3}
    assert third_left in ({third + " a": 1}, {third + " b": 2})
    assert {k: n for k, n in left.items() if k[0] != 3} == {(1, copied): 1, (2, clean): 1, (4, None): 1, (None, clean): 1}


def test_run_equals_a_plain_chain(spark):
    """All stages by brute force, ids and token ids, on texts of every length."""
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").collect()
    rows = [(r.doc_id, r.text or "") for r in read("documents")]
    n_all = len(rows)

    stats = {i: quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for i, t in rows}
    label = {r.doc_id: r.quality for r in read("labels") if r.quality in (0, 1) and r.doc_id in stats and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    own = {k: np.array([stats[i] for i, x in label.items() if x == k]) for k in (0, 1)}
    model = quality.fit({k: (float(len(x)), x.sum(0), x.T @ x) for k, x in own.items()})
    rows = [(i, t) for i, t in rows if model.score(stats[i][None])[0] >= P.QUALITY]
    n_good = len(rows)

    least = {i: c for i, _, c in groups(rows, P.ngram_join.Rule(5, 80, 100))}
    rows = [(i, t) for i, t in rows if least[i] == i]
    n_single = len(rows)

    spans_of = {i: spans for i, _, spans, _ in cuts(rows)}
    whole = {i: b"".join(c for c, at in _characters(t.encode()) if not any(s <= at and at + len(c) <= e for s, e in spans_of[i])).decode() for i, t in rows}
    assert whole != dict(rows)

    items = [(r.item_id, r.text) for r in read("benchmark")]
    word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    grams = lambda t: shingles(" ".join(word.findall(t or "")), 5)
    parts = {j: grams(t) for j, t in items}
    leaked = set()
    for i, t in whole.items():
        has = grams(t)
        near = [(j, u) for j, u in items if len(word.findall(u or "")) < 5 or parts[j] & has]  # others share nothing
        leaked |= {d for d, *_ in windows([(i, t)], near)}

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {i: plain.encode_ordinary(t) for i, t in whole.items() if i not in leaked}
    assert n_all > n_good > n_single > 0
    got = [(r.doc_id, r.ids) for r in P.run(spark, DATA).collect()]
    assert len(got) == len(expected) and dict(got) == expected
