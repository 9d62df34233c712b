import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from driftline.llm import bpe, decontam, embed_dedup, sharding
from driftline.llm import kernels as K

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, "Hello  world\n\n x", "it's 12 <|endoftext|> é日本", "word " * 40_000, " " * 200_000 + "x", "a" * 150_000, "\t\n" * 50_000, "ab cd " * 20_000]


def test_encode_decode_equals_the_plain_library(spark, plain):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Decoded long, ids string")
    assert bpe.encode_decode(df, RANKS, PATTERN).columns == ["doc_id", "Decoded_input", "ids_input", "ids", "decoded"]
    got = {r.doc_id: r for r in bpe.encode_decode(df, RANKS, PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].ids == plain.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    ids = bpe.encode(df, RANKS, PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS, PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0
    assert {(r.Decoded_input, r.ids_input) for r in bpe.decode(ids, RANKS, PATTERN).collect()} == {(i, "x") for i in range(len(TEXTS))}
    assert bpe.encode(df.union(df), RANKS, PATTERN, ids_col="text").count() == 2 * len(TEXTS)
    with pytest.raises(ValueError, match="names"):
        bpe.decode(ids, RANKS, PATTERN, out_col="IDS")


def test_cuts_are_safe(plain):
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["a", "b", " ", "  ", "\n", "'s", "1", "é", " ", "!", "日"]) for _ in range(80))
        assert [i for s in bpe.segments(t, 7) for i in plain.encode_ordinary(s)] == plain.encode_ordinary(t)


def shard(spark, rows, path, n=4, slots=64):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sharding.shard_documents(df, n, path, slots=slots).collect()


def loads(got):
    by_bytes, places = Counter(), defaultdict(list)
    for r in got:
        by_bytes[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return by_bytes


def test_shards_are_even_and_places_gapless(spark, prose, tmp_path):
    rows = [(i, prose(random.Random(i).randint(1, 60), i)) for i in range(800)] + [(9, None), (9, ""), (None, "x"), (None, "x")]
    got = shard(spark, rows, f"{tmp_path}/m")
    assert len(got) == len(rows)
    by_bytes = loads(got)
    assert max(by_bytes.values()) < 1.03 * min(by_bytes.values())
    text = dict(rows[:800])
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got if r.doc_id is not None and r.doc_id != 9)
    versions = sharding.load_map(spark, f"{tmp_path}/m")
    assert len(versions) == 64 and versions[0][0] == 1
    place = {slot: shard_ for _, slot, shard_, _, _ in versions}
    assert all(r.shard == place[r.virtual_slot] for r in got)
    assert sum(v[3] for v in versions) == sum(by_bytes.values()) and sum(v[4] for v in versions) == len(rows)
    assert shard(spark, [], f"{tmp_path}/none") == [] and len(sharding.load_map(spark, f"{tmp_path}/none")) == 64


def test_a_stored_map_is_edited_not_replaced(spark, prose, tmp_path):
    path = f"{tmp_path}/m"
    rows = [(i, prose(30, i)) for i in range(600)]
    first = {r.doc_id: r for r in shard(spark, rows, path)}
    again = {r.doc_id: r for r in shard(spark, rows, path)}
    assert all(again[i].shard == r.shard and again[i].virtual_slot == r.virtual_slot for i, r in first.items())
    grown = shard(spark, rows, path, 5)
    by_bytes = loads(grown)
    assert set(by_bytes) == set(range(5)) and max(by_bytes.values()) < 1.1 * min(by_bytes.values())
    stayed = sum(first[r.doc_id].shard == r.shard for r in grown)
    assert stayed > 0.6 * len(rows) and all(first[r.doc_id].virtual_slot == r.virtual_slot for r in grown)
    assert sharding.load_map(spark, path)[0][0] == 4


def test_rows_without_id_are_spread(spark, tmp_path):
    df = spark.createDataFrame([(None, "")] * 400, "doc_id long, text string").repartition(16)
    got = sharding.shard_documents(df, 4, f"{tmp_path}/m", slots=64).collect()
    assert len(got) == 400 and len({r.virtual_slot for r in got}) > 4
    loads(got)


def test_query_places_every_row_of_the_table(spark):
    from driftline.llm import queries

    d = "/root/testdata/sf0.001"
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op8_sharding(spark, d).collect()
    by_bytes = loads(got)
    assert sorted(r.doc_id for r in got) == sorted(text) and set(by_bytes) <= set(range(40))
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None for r in got)
    assert sum(by_bytes.values()) == sum(len(t) + 16 for t in text.values())


def test_rebalance_edits_the_map(spark, tmp_path):
    r = random.Random(2)
    first = sharding.even_out(sharding.first_map(8, 512), [(s, r.randint(50, 150), 10) for s in range(512)])
    grown = sharding.rebalance(first, 9)
    was, now = {v[1]: v[2] for v in first}, {v[1]: v[2] for v in grown}
    moved = {s for s in was if was[s] != now[s]}
    assert moved and all(now[s] == 8 for s in moved)
    load = Counter()
    for _, _, shard_, size, _ in grown:
        load[shard_] += size
    assert max(load.values()) < 1.1 * min(load.values())
    back = {v[1]: v[2] for v in sharding.rebalance(grown, 8)}
    assert all(back[s] == now[s] for s in now if now[s] < 8) and max(back.values()) == 7
    path = f"{tmp_path}/map"
    assert sharding.load_map(spark, path) == []
    sharding.save_map(spark, first, path)
    sharding.save_map(spark, grown, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == first


@pytest.mark.parametrize("weights", [[], [0] * 64, [10**9] + [1] * 63, list(range(64)), [7] * 64])
def test_even_out_ends_and_keeps_all_slots(weights):
    got = sharding.even_out(sharding.first_map(5, 64), [(i, w, 1) for i, w in enumerate(weights)])
    assert [v[1] for v in got] == list(range(64)) and {v[0] for v in got} == {1}
    load = Counter({s: 0 for s in range(5)})
    for _, _, shard_, size, _ in got:
        load[shard_] += size
    if weights and max(weights) < 100:
        assert max(load.values()) - min(load.values()) <= max(weights)


def links(rows, least=0.93):
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b >= least * np.linalg.norm(a) * np.linalg.norm(b):
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(near[i]), c, vec == c))
    return sorted(out, key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=str)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    r = np.random.default_rng(3)
    rows = []
    for g in range(40):
        base = r.normal(size=24)
        for _ in range(r.integers(1, 30 if g < 2 else 4)):
            v = (base + r.normal(size=24) * 0.1).astype(np.float32)
            rows.append((int(len(rows) * 3 % 1000), [float(x) for x in v], int(g % 3)))
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(3000, rows[0][1], 99), (3001, rows[0][1], None)]
    assert vectors(spark, rows) == links(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, float("nan")], 1), (5, [1.0, float("inf")], 1), (6, [1.0, None], 1), (7, [1.0, 2.0], None)],
        [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)],
        [(2, [3e38, 3e38], 1), (1, [1e-38, 1e-38], 1)],
    ],
)
def test_vector_corner_cases(spark, rows):
    assert vectors(spark, rows) == links(rows)


def test_vectors_with_one_key_take_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    class Narrow:
        def __getattr__(self, name):
            return (lambda *c: F.xxhash64(*c) % 3 if len(c) == 2 and c[0] == "label" else F.xxhash64(*c)) if name == "xxhash64" else getattr(F, name)

    monkeypatch.setattr(embed_dedup, "F", Narrow())
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)], i % 2) for i in range(20)]
    rows += [(100 + i, v, lab) for i, v, lab in rows[:6]] + [(200, None, 1)]
    assert vectors(spark, rows) == links(rows)


@pytest.mark.parametrize("dim", [16, 64, 256, 768])
def test_recall_at_the_threshold(dim):
    """Pairs of cosine exactly 0.93 share a bucket in at least 97 of 100 cases."""
    r = np.random.default_rng(5)
    a = r.normal(size=(600, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(600, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (1_000, 1_000_000):
        t = embed_dedup.Tables.of(n, dim)
        x, y = embed_dedup.buckets(a, t), embed_dedup.buckets(b, t)
        met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() >= 0.97


def find(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in decontam.find(d, b).collect())


def windows(docs, items):
    """Best window of each pair by definition."""
    import re

    fold = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    out = []
    for d, t in docs:
        w = fold(t)
        for i, u in items:
            own = Counter(cut(fold(u)))
            n, best = len(fold(u)), None
            for a in range(max(1, len(w) - n + 1)) if n and w else ():
                x = Counter(cut(w[a : a + n]))
                both = sum((x & own).values())
                s = both / (own.total() + x.total() - both)
                if s >= 0.8 and (best is None or s > best[2]):
                    best = (d, i, s, a, min(n, len(w)))
            out += [best] * bool(best)
    return sorted(out)


def test_decontamination_against_brute_force(spark, prose):
    r = random.Random(6)
    items = [(i, prose(r.randint(16, 50), 50 + i)) for i in range(12)] + [(90, "two words"), (91, ""), (92, None), (93, "...")]
    docs = []
    for i in range(40):
        t = prose(r.randint(0, 80), 500 + i)
        if i % 2:
            w = r.choice(items[:12])[1].split(" ")
            if i % 4 == 3:
                w[r.randrange(len(w))] = "changed"
            t += ". " + ", ".join(w).upper() + "! " + prose(30, i)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "Two, words"), (104, items[3][1].rsplit(" ", 2)[0]), (105, "two"), (106, items[4][1][:40]), (103, "word " * 30_000 + items[0][1])]
    got, exp = find(spark, docs, items), windows(docs, items)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in exp]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in exp])
    clean = decontam.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {x[0] for x in exp}


def test_several_index_passes(spark, prose, monkeypatch):
    items = [(i, prose(20, i)) for i in range(20)]
    docs = [(i, t) for i, t in items]
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1500)
    assert [x[:2] for x in find(spark, docs, items)] == [(i, i) for i in range(20)]
    assert find(spark, [], items) == [] and find(spark, docs, []) == []


@pytest.mark.parametrize("n", [60, 200, 3000])
def test_multi_index_finds_all_within_the_radius(n):
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(n)]
    index = decontam.MultiIndex(np.array(prints, np.uint64), np.array([7] * n))
    for p in prints[:60]:
        q = p
        for bit in r.sample(range(64), r.randint(0, 20)):
            q ^= 1 << bit
        window, item = index.near(7, np.array([0, q], np.uint64))
        assert item[window == 1].tolist() == [i for i, x in enumerate(prints) if (x ^ q).bit_count() <= decontam.RADIUS]
        assert not len(index.near(8, np.array([q], np.uint64))[0])


def test_blocks_cut_the_candidates():
    """A random fingerprint meets about a fifth of the items in a block."""
    r = np.random.default_rng(3)
    prints = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 4000, dtype=np.uint64)
    met = np.zeros(3999, bool)
    for first, bits, bound in decontam.BLOCKS:
        own, other = (decontam.MultiIndex._block(x, first, bits) for x in (prints[1:], prints[:1]))
        met |= decontam.distance(own, np.repeat(other, 3999)) <= bound
    assert 0.1 < met.mean() < 0.25


def test_recall_at_the_least_similarity():
    """Windows of similarity 0.8 or little more lie within the radius in nearly all cases."""
    r = np.random.default_rng(4)
    seen = near = 0
    for n in (9, 18, 45, 90):
        for _ in range(400):
            own = r.integers(0, 1 << 62, n, dtype=np.uint64)
            other = own.copy()
            changed = int(n * 0.2 / 1.8)  # 1 - s over 1 + s
            other[:changed] = r.integers(0, 1 << 62, changed, dtype=np.uint64)
            seen += 1
            near += (decontam.simhash(K.mix(own)) ^ decontam.simhash(K.mix(other))).bit_count() <= decontam.RADIUS
    assert near >= 0.99 * seen


def test_edited_items_near_the_threshold(spark, prose):
    """Items with words changed at one end, so that similarities lie around 0.8."""
    r = random.Random(8)
    items = [(i, prose(r.randint(20, 60), 900 + i)) for i in range(30)]
    docs = []
    for i, t in items:
        w = t.split(" ")
        k = r.randint(1, max(2, len(w) // 6))
        docs.append((i, " ".join([prose(15, i), *w[:-k], prose(k + 10, 70 + i)])))
    got, exp = find(spark, docs, items), windows(docs, items)
    assert 8 < len(exp) < 30
    missed = {x[:2] for x in exp} - {x[:2] for x in got}
    assert {x[:2] for x in got} <= {x[:2] for x in exp} and len(missed) <= len(exp) // 10


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_odd_benchmarks(spark, prose, kind):
    text = prose(20, 3)
    cast = (lambda x: None if x is None else str(x)) if kind == "string" else (lambda x: x)
    b = spark.createDataFrame([(cast(1), text, "x"), (cast(1), text, "x"), (cast(None), text, "y"), (cast(2), None, None)], f"item_id {kind}, text string, id string")
    d = spark.createDataFrame([(cast(5), "a " + text, 1), (cast(5), "a " + text, 1), (cast(None), text, 2), (cast(6), "", 3)], f"doc_id {kind}, text string, similarity int")
    got = decontam.find(d, b)
    assert dict(got.dtypes)["item_id"] == kind and dict(got.dtypes)["id"] == kind
    exp = [(d_, i, 1.0, at, 20) for d_, at in ((cast(5), 1), (cast(5), 1), (cast(None), 0)) for i in (cast(1), cast(1), cast(None))]
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(exp, key=str)
    left = decontam.drop_contaminated(d, b)
    assert left.columns == d.columns and [x.doc_id for x in left.collect()] == [cast(6)]


def test_an_index_is_as_large_as_it_is_planned(prose):
    items = [(i, prose(40, i)) for i in range(2000)]
    assert decontam.Index(items, 0.8).nbytes() <= 2000 * (40 * decontam.WORD_BYTES + decontam.ITEM_BYTES)
