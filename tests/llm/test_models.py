import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import quality, toxicity


def test_quality_separates_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score_documents(spark.read.parquet(f"{d}/documents.parquet"), labels)
    assert got.count() == 1000
    r = got.join(labels, F.col("id") == F.col("doc_id")).filter("held_out").agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("int"))).first()
    assert r[0] >= 0.97


def test_held_out_follows_the_crc(spark):
    rows = [(i, "some words here and there", None, None) for i in range(50)] + [(None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    for found, m, h in ((quality.score_documents(df, labels), 5, 0), (toxicity.score_documents(df, labels), 3, 1)):
        rows = found.collect()
        assert len(rows) == 51
        for r in rows:
            assert r.held_out == (r.id is None or zlib.crc32(str(r.id).encode()) % m == h)
            assert 0 <= r.score <= 1


def test_quality_moments_equal_numpy(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(40, quality.DIM)), r.integers(0, 2, 40)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, x)], "label int, stats array<double>")
    got = quality.moments(df)
    for k in (0, 1):
        own = x[y == k]
        assert got[k][0] == len(own)
        np.testing.assert_allclose(got[k][1], own.sum(0))
        np.testing.assert_allclose(got[k][2], own.T @ own)


def test_cholesky_score_is_the_gaussian_posterior():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(60, quality.DIM)), r.normal(1, 2, size=(90, quality.DIM))
    model = quality.fit({0: (60.0, a.sum(0), a.T @ a), 1: (90.0, b.sum(0), b.T @ b)})
    x = r.normal(size=(5, quality.DIM))
    log = []
    for k in (0, 1):
        cov = model.chol[k] @ model.chol[k].T
        d = x - model.mean[k]
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len((a, b)[k]) + 1) / 152))
    np.testing.assert_allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])), rtol=1e-6)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, None, None)], [(1, 0, 0), (2, 1, 1)]])
def test_few_labels_and_empty_texts(spark, labels):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 20_000), (3, "word")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for found in (quality.score_documents(df, known), toxicity.score_documents(df, known)):
        assert all(r.score is not None and 0 <= r.score <= 1 for r in found.collect())
    assert quality.score_documents(df.limit(0), known).count() == 0


def test_keep_good_keeps_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality.keep_good(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert got.columns == docs.columns
    assert 0 < got.count() <= docs.count()


def test_machine_learns_a_pair_that_no_single_term_tells():
    """Label 1 only where two terms meet; each alone is as common among label 0."""
    r = random.Random(4)
    rows, labels = [], []
    for _ in range(3000):
        kind = r.randrange(4)
        own = {1: [10], 2: [20], 3: [10, 20]}.get(kind, [])
        rows.append(sorted({*own, *(r.randrange(100, 300) for _ in range(5))}))
        labels.append(float(kind == 3))
    end = np.cumsum([len(x) for x in rows])
    fm = toxicity.fit(np.array([t for x in rows for t in x], np.int32), end, np.array(labels))
    at = fm.lookup()
    score = lambda *t: fm.score(at[np.array(t)], np.zeros(len(t), int), 1)[0]
    assert score(10, 20) > 0.7 > 0.3 > max(score(10), score(20))


def _toxic_rows(n, prose):
    """(doc_id, text, label): every sixth text holds one of two rude words; one text in ten is repeated."""
    r, rows = random.Random(5), []
    for i in range(n):
        label = int(i % 6 == 0)
        text = prose(r.randrange(5, 40), i) + (r.choice([" blorg", " Skavver"]) if label else "")
        rows.append((i, text, label))
        if i % 10 == 0:
            rows.append((n + i, text, label))
    return rows


def test_training_equals_a_fit_on_all_terms_of_distinct_texts(spark, prose):
    """Terms tested on the executors give the machine that one fit of the whole rows gives."""
    rows = [*_toxic_rows(240, prose), (10_000, None, 0), (10_001, "", 0), (10_002, prose(30_000, 1), 0)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] * 2, "doc_id long, toxic int")
    got = toxicity.train(docs, labels, "toxic", 3, 1)
    own = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    features = toxicity.featurise(spark.createDataFrame(own, "doc_id long, text string, label int"))
    label_of = {x[0]: x[2] for x in own}
    plain = {(h.key, label_of[h.id]): h.terms for h in features.select("id", "terms", F.xxhash64("terms").alias("key")).collect()}
    order = sorted(plain)
    want = toxicity.fit(np.array([t for k in order for t in plain[k]], np.int32), np.cumsum([len(plain[k]) for k in order]), np.array([float(k[1]) for k in order]))
    assert len(want.term) > 0
    np.testing.assert_array_equal(got.term, want.term)
    np.testing.assert_allclose(got.weight, want.weight)
    np.testing.assert_allclose(got.factor, want.factor)
    assert got.bias == pytest.approx(want.bias)


def test_sample_is_bounded_where_an_id_has_many_texts(spark, prose):
    """A third of all rows under one labelled id do not all come into the sample."""
    docs = spark.createDataFrame([(i if i < 2000 else 0, prose(4, i)) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    found = toxicity.sample(docs, labels, "toxic", 3, 1, 300).count()
    whole = toxicity.sample(docs, labels, "toxic", 3, 1, 10_000).count()
    assert found <= 450
    assert whole == sum((zlib.crc32(str(i).encode()) % 3 != 1) * (1001 if i == 0 else 1) for i in range(2000))


def test_model_is_bounded_in_terms(monkeypatch):
    counts, hits = np.full(1 << toxicity.BITS, 0), np.full(1 << toxicity.BITS, 0)
    counts[:6], hits[:6] = 100, [100, 90, 80, 60, 50, 10]
    assert toxicity.telling(counts, hits, 1000, 200).tolist() == [0, 1, 2, 3, 4]
    monkeypatch.setattr(toxicity, "MAX_TERMS", 2)
    assert toxicity.telling(counts, hits, 1000, 200).tolist() == [0, 1]


def test_forward_substitution_solves_the_triangle():
    r = np.random.default_rng(3)
    lower, right = np.tril(r.normal(size=(6, 6))) + 5 * np.eye(6), r.normal(size=(6, 4))
    np.testing.assert_allclose(lower @ quality._substitute(lower, right), right)
    assert quality._substitute(lower, right[:, :0]).shape == (6, 0)


def test_fitting_for_keep_good_runs_one_python_worker_a_task(spark, monkeypatch):
    """Statistics are made and added up in separate jobs, also where labels are broadcast."""
    plans, moments = [], quality.moments

    def seen(labelled):
        plans.append(labelled._jdf.queryExecution().optimizedPlan().toString())
        return moments(labelled)

    monkeypatch.setattr(quality, "moments", seen)
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
    assert kept == {r.id for r in quality.score_documents(docs, labels).filter("score >= 0.3").collect()}
