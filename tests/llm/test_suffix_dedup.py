import hashlib
import random

import numpy as np
import pytest

from driftline.llm import suffix_dedup as S


def brute(rows):
    """id, removed spans and kept bytes by definition."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for k in range(len(b) - S.LENGTH + 1):
            first.setdefault(b[k : k + S.LENGTH], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - S.LENGTH + 1):
            f = first[b[k : k + S.LENGTH]]
            if f is not None and (i is None or f < i):
                cover[k : k + S.LENGTH] = True
        step = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
        out.append((i, len(b), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.dedup(df, **more).collect()
    return sorted(((r.id, r.n_bytes, [(s.start, s.end) for s in r.spans], hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str)


def test_against_brute_force(spark, prose):
    r = random.Random(5)
    base = [prose(60, i) for i in range(6)]
    rows = []
    for i in range(40):
        parts = [prose(r.randint(1, 20), 100 + i)]
        for _ in range(r.randint(0, 3)):
            b = r.choice(base)
            a = r.randint(0, len(b) - 60)
            parts += [b[a : a + r.randint(30, 200)], prose(r.randint(0, 9), r.random())]
        rows.append((i * 3 % 41, r.choice(["", " ", "\n"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (7, rows[3][1])]
    assert run(spark, rows, bucket_bytes=4000) == brute(rows)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, "short")],
        [(1, "x" * 49), (2, "x" * 49)],
        [(1, "x" * 50), (2, "x" * 50), (2, "x" * 50), (3, "x" * 51)],
        [(5, "ab" * 3000), (4, "ab" * 2000 + "c"), (None, "ab" * 100), (None, "ab" * 100)],
        [(1, "é" * 60), (2, "zé" + "é" * 60), (3, "日本語" * 30), (4, "語日本語" + "日本語" * 30)],
        [(2, "q" * 200_000), (1, "q" * 60)],
    ],
)
def test_corner_cases(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_anchors_of_many_buckets(spark, prose):
    line = prose(14, 77)
    rows = []
    for i in range(120):
        own = prose(25, i)
        rows.append((i, own[: i % 90] + line + own[i % 90 :] + (line[5:70] if i % 3 == 0 else "")))
    for many in (1, 2, 5):
        assert run(spark, rows, bucket_bytes=2000, many_buckets=many) == brute(rows)


def test_hot_text_is_salted(spark, prose):
    text = prose(40, 1)
    rows = [(i, text) for i in range(300)] + [(1000, "begin " + text + " end"), (-5, "other " + text[20:])]
    assert run(spark, rows, bucket_bytes=2000) == brute(rows)


def test_texts_keep_whole_characters_and_columns(spark):
    rows = [(1, "a" + "é" * 40, "x"), (2, "b" + "é" * 40 + "tail", "y"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = {r.doc_id: (r.text, r.bucket) for r in S.dedup_texts(df).collect()}
    assert got == {1: ("a" + "é" * 40, "x"), 2: ("btail", "y"), 3: ("", "z")}


@pytest.mark.parametrize("shallow", [8, 24, 50])
def test_deep_shallow_sort_orders_suffixes(shallow):
    r = random.Random(shallow)
    for alphabet, n in (("ab", 400), ("abcdefgh", 300), ("a", 120)):
        text = "".join(r.choice(alphabet) for _ in range(n)).encode() * 2
        buffer = np.frombuffer(text, np.uint8)
        at = np.array([r.randrange(0, len(text) - 50) for _ in range(500)])
        order, same = S.deep_shallow_sort(buffer, at, 50, shallow=shallow)
        cut = [text[i : i + 50] for i in at[order]]
        assert cut == sorted(cut)
        assert [a == b for a, b in zip(cut, cut[1:])] == [a == b for a, b in zip(same, same[1:])]


def test_hot_texts_of_any_number_are_salted(spark, prose, monkeypatch):
    """More hot texts than cells: each cell's texts are salted, and results stay."""
    monkeypatch.setattr(S.B, "CELLS", 4)
    texts = [prose(30, i) for i in range(12)]
    rows = [(i, texts[i % 12]) for i in range(400)] + [(None, texts[0])] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, buckets, _ = S.B.deal(df, "doc_id", "text", 2000)
    assert max(r["count"] for r in dealt.groupBy("bucket").count().collect()) < 40 and buckets > 8
    assert run(spark, rows, bucket_bytes=2000) == brute(rows)


def test_hash_ranges_follow_the_hashes_not_the_buckets(spark, prose):
    """Thousands of buckets exchange their hashes in a few blocks each."""
    rows = [(i, prose(20, i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    source, buckets, total = S.B.deal(df, "doc_id", "text", 128)
    parts = S.B.parts_for(total, S.SPAN // 2)
    assert buckets > 1500 and parts == 8
    assert S.B.parts_for(10**14, S.SPAN // 2) * S.B.PART_HASHES * (S.SPAN // 2) < 1.1 * 10**14
    assert run(spark, rows[:300], bucket_bytes=128) == brute(rows[:300])


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="whole number"):
        S.dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
