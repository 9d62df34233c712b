import random
import re
from collections import Counter, defaultdict

import pytest

from driftline.llm import ngram_join as N
from driftline.llm.components import components


def shingles(text, k):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, rule):
    sets = [shingles(t, rule.k) for _, t in rows]
    where = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            where[x].add(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x] if j < i).items():
            if both * rule.of >= (len(s) + len(sets[j]) - both) * rule.least:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.id, r.n_shingles, r.component_id) for r in N.group_documents(df, rule).collect()), key=str)


def edited(text, r, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("rule", [N.Rule(4, 85, 100), N.Rule(5, 80, 100)])
def test_against_brute_force(spark, prose, rule):
    r = random.Random(3)
    line = prose(11, 999)
    rows = []
    for g in range(25):
        base = prose(r.randint(5, 120), g)
        for _ in range(r.choice([1, 1, 2, 4])):
            t = edited(base, r, r.randint(0, 3))
            if r.random() < 0.4:
                t += "\n" + line
            if r.random() < 0.2:
                t = t.upper()
            rows.append((len(rows) * 7 % 1009, t))
    assert run(spark, rows, rule) == brute(rows, rule)


def test_chain_links_reach_the_smallest_id(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 5 : i * 5 + 120])) for i in range(12)]
    got = run(spark, rows, N.Rule(4, 85, 100))
    assert got == brute(rows, N.Rule(4, 85, 100))
    assert {c for _, _, c in got} == {89}


def test_threshold_ties_link(spark):
    a = [f"w{i}" for i in range(23)]  # 20 shingles
    for extra, linked in ((3, True), (4, False)):  # 17 of 20 shared at 3 cut words
        rows = [(1, " ".join(a)), (2, " ".join(a[: 23 - extra]))]
        got = {d: c for d, _, c in run(spark, rows, N.Rule(4, 85, 100))}
        assert (got[2] == 1) is linked


def test_crowded_group_of_near_copies(spark, prose):
    r = random.Random(8)
    base = prose(150, 1)
    rows = [(i + 10, edited(base, r, 1)) for i in range(60)] + [(i, base) for i in range(5)] + [(500 + i, prose(12, 7000 + i) + " " + base[:80]) for i in range(40)]
    assert run(spark, rows, N.Rule(4, 85, 100)) == brute(rows, N.Rule(4, 85, 100))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, ""), (3, " \n"), (None, None)],
        [(1, "a b"), (2, "A  B"), (2, "a b"), (3, "a b c")],
        [(None, "a b c d e f"), (4, "a b c d e f"), (None, "x y z w v u")],
        [(2, "a " * 50_000), (1, "a a a a a")],
    ],
)
def test_corner_cases(spark, rows):
    rule = N.Rule(4, 85, 100)
    assert run(spark, rows, rule) == brute(rows, rule)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (9, 3), (20, 21), (7, 7), (22, 21), (30, 31)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rule", [N.Rule(4, 85, 100), N.Rule(5, 80, 100)])
def test_crowds_in_small_blocks(spark, prose, monkeypatch, rule):
    """Texts of several sizes around common passages, so that tokens of many nodes mix components."""
    for name, value in (("SMALL", 2), ("BLOCK", 8), ("COLUMNS", 64)):
        monkeypatch.setattr(N, name, value)
    r = random.Random(11)
    common = [prose(45, 900 + i) for i in range(2)]
    rows = []
    for g in range(30):
        base = " ".join([*common[: g % 3], prose(r.randint(2, 12), g)])
        for _ in range(r.choice([1, 2, 4])):
            rows.append((len(rows) * 7 % 1009, edited(base, r, r.randint(0, 2))))
    assert run(spark, rows, rule) == brute(rows, rule)


def test_sets_with_one_key_take_others(spark, prose, monkeypatch):
    real = N.set_keys
    monkeypatch.setattr(N, "set_keys", lambda token, sizes: (real(token, sizes)[0] % 3, real(token, sizes)[1]))
    rows = [(i, prose(30, i // 2)) for i in range(20)] + [(90, ""), (91, None)]
    rule = N.Rule(4, 85, 100)
    assert run(spark, rows, rule) == brute(rows, rule)


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="whole number"):
        N.group_documents(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, 8, "x"), (2, "a b c d e", 7, 8, "x")], "doc_id int, text string, node long, id long, component_id string")
    assert sorted(map(tuple, N.group_documents(df).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_a_hot_key_is_dealt_out_and_no_row_lost(spark, monkeypatch):
    from pyspark.sql import functions as F

    from driftline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(2000).select(F.when(F.col("id") < 900, F.lit(1)).otherwise(F.col("id") % 40).cast("long").alias("k"), "id")
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    joined = common.join_per_key(rows, per_key, "k")
    assert sorted(map(tuple, joined.select("k", "id", "n", "top").collect())) == sorted(map(tuple, rows.join(per_key, "k").select("k", "id", "n", "top").collect()))
    assert joined.columns == ["k", "id", "n", "top"]


def test_cut_tables_are_cleared(spark):
    import os

    from driftline.llm import common

    with common.cleared(spark):
        df, path = common.cut_at(spark.range(3))
        at = path.removeprefix("file:")
        assert df.count() == 3 and os.path.exists(at)
    assert not os.path.exists(at)
