import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relslice.llm import entries, langid, quality, toxicity

SF = "/root/testdata/sf0.1"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def test_held_out_rows(spark):
    got = spark.createDataFrame([(i,) for i in range(300)] + [(None,)], "doc_id long").select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


# Toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    out = entries.op1_toxicity(spark, SF).join(read(spark, "labels"), "doc_id").where("held_out").toPandas()
    assert auc(out["score"].to_numpy(), out["toxic"].to_numpy()) > 0.95
    assert (out["predicted"] == (out["score"] >= 0.7)).all()
    assert out[out["toxic"] == 0]["predicted"].mean() < 0.02 and out[out["toxic"] == 1]["predicted"].mean() > 0.8


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text"), read(spark, "labels", "/root/testdata/sf0.01")
    one = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    two = toxicity.fit(docs.withColumn("extra", F.lit(1)), flipped)
    assert np.array_equal(one.buckets, two.buckets) and np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_features_are_words_and_stems():
    a, b = toxicity.presence(pa.array(["Worthless! stupid", "x worthl7stupid"]))
    assert len(a) == 2 + 4 and len(set(a) & set(b)) == 5  # stupid and its two stems, and both stems of the longer word
    assert toxicity.presence(pa.array(["", None, "..."])) is not None and all(x.size == 0 for x in toxicity.presence(pa.array(["", None, "..."])))


def test_negative_risk_is_stepped_back():
    rng = np.random.default_rng(0)
    u = [np.unique(rng.integers(10, 60, 8)) for _ in range(300)] + [np.append(np.unique(rng.integers(10, 60, 8)), 5) for _ in range(30)]
    p = [np.append(np.unique(rng.integers(10, 60, 8)), 5) for _ in range(40)]
    model = toxicity.fit_nnpu(p, u, 0.1)
    assert model.buckets.tolist()[0] == 5 and model.weights[0] > 2 and model.bias < -1
    assert toxicity.fit_nnpu([], u, 0.25).scores(pa.array(["a", None])).tolist() == pytest.approx([0.25, 0.25])


def test_toxicity_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "stupid", 5.0), (2, "x " * 50_000, 5.0)], "doc_id long, text string, score double")
    model = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == pytest.approx([0.1] * 4)


# Language -----------------------------------------------------------------------------------------------------


def brute_kernel(a, b):
    def grams(t):
        t = re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", " ", t.lower())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    x, y = grams(a), grams(b)
    return len(x & y) / max(1, (len(x) * len(y)) ** 0.5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé ñ.,\n日", min_size=1, max_size=40), min_size=2, max_size=6))
def test_kernel_equals_brute_force(some):
    sets = langid.ngrams(pa.array(some))
    model = langid.fit_kernel_ridge(sets, [str(i % 2) for i in range(len(sets))])
    order = [i for k in range(len(some)) for i in ([2 * k] if 2 * k < len(some) else []) + ([2 * k + 1] if 2 * k + 1 < len(some) else [])]
    assert model.kernel(sets) == pytest.approx(np.array([[brute_kernel(a, some[j]) for j in order] for a in some]), abs=1e-5)


def test_language_on_held_out_rows(spark):
    out = entries.op6_language(spark, "/root/testdata/sf0.01").join(read(spark, "documents", "/root/testdata/sf0.01"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat and", "en"), (2, "le chat et", "fr"), (3, "the dog the", "en"), (4, "la vie est", "fr")] * 3, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é"), (None, "the the " * 20_000)], "doc_id long, text string")
    got = [(r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()]
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[3][0] in ("en", "fr") and got[4][0] == "en"
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_rare_languages_are_learned_from_large_tables(spark):
    common = spark.range(60_000).select("id", F.concat(F.lit("the cat and the dog number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(60_000, 60_015).select("id", F.lit("le chat et la vie est belle").alias("text"), F.lit("fr").alias("lang"))
    docs = common.unionByName(rare).withColumnRenamed("id", "doc_id")
    for seed in range(3):
        model = langid.fit(docs, seed=seed, max_labelled=300)
        assert model.languages == ["en", "fr"]
        assert {r["lang_pred"] for r in langid.identify(rare.select("text"), model).collect()} == {"fr"}


# Quality ------------------------------------------------------------------------------------------------------


def test_quality_on_held_back_ratings(spark):
    docs, ratings = read(spark, "documents"), entries.ratings(spark, SF)
    train = ratings.where(~toxicity.held_out("doc_id"))
    model = quality.fit(docs, train)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    out = quality.grade(docs.select("doc_id", "text"), model).join(ratings.where(toxicity.held_out("doc_id")), "doc_id").toPandas()
    tail = np.array(out["grade_tails"].tolist())
    assert auc(tail[:, 0], (out["rating"] > 0).astype(int).to_numpy()) > 0.99
    assert (np.diff(tail, axis=1) <= 0).all() and out["expected_grade"].to_numpy() == pytest.approx(tail.sum(axis=1))
    assert (tail[out["rating"] == 2][:, 0] >= 0.5).mean() > 0.99


def test_five_grades_are_ordered():
    rng = np.random.default_rng(1)
    rows, ratings = [], []
    for _ in range(400):
        g = int(rng.integers(0, 5))
        rows.append((np.array([3, 7], np.int32), np.array([g / 4 + rng.normal(0, 0.05), 0.5], np.float32)))
        ratings.append(float(g))
    model = quality.fit_ordinal(rows, ratings, steps=600)
    z = np.array([model.weights[a] @ v for a, v in rows])
    got = (z[:, None] > model.thresholds).sum(axis=1)
    assert (np.diff(model.thresholds) > 0).all() and np.abs(got - ratings).mean() < 0.2


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "a b", 1.0), (3, "Z!! " * 30_000, 1.0)], "doc_id long, text string, grade_tails double")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, rating double"))
    assert [(r["expected_grade"], r["grade_tails"]) for r in quality.grade(docs, none).collect()] == [(0.0, [])] * 4
    two = quality.fit(docs, spark.createDataFrame([(1, 0.0), (3, 1.0), (None, 1.0), (2, None)], "doc_id long, rating double"))
    assert two.grades == [0.0, 1.0] and len(quality.grade(docs, two).first()["grade_tails"]) == 1


def test_training_rows_do_not_depend_on_the_input_order(spark):
    """Repeated keys with several texts and null keys: the same model whatever the input's order and partitions."""
    rows = [(i % 40, f"{'bad awful' if i % 40 < 12 else 'fine day'} w{i % 7} v{i}", i % 3) for i in range(400)] + [(None, f"null w{i}", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, int(i < 12), i % 3) for i in range(40)] + [(None, 1, 2)], "doc_id long, toxic int, rating int")
    models = [toxicity.fit(d, labels, seed=1, max_positive=30, max_unlabelled=60) for d in (docs.repartition(5), docs.orderBy(F.desc("text")).coalesce(1))]
    assert np.array_equal(models[0].buckets, models[1].buckets) and np.array_equal(models[0].weights, models[1].weights)
    graded = [quality.fit(d, labels.select("doc_id", "rating"), seed=1, max_rated=50) for d in (docs.repartition(5), docs.orderBy(F.desc("text")).coalesce(1))]
    assert np.array_equal(graded[0].weights, graded[1].weights) and np.array_equal(graded[0].thresholds, graded[1].thresholds)


def nn_risk(w, bias, positive, unlabelled, prior):
    """The non-negative risk with logistic loss, text by text."""
    def loss(s, y):
        return np.log1p(np.exp(-y * s))

    f_p = [sum(w[j] for j in x) + bias for x in positive]
    f_u = [sum(w[j] for j in x) + bias for x in unlabelled]
    clean = np.mean([loss(s, -1) for s in f_u]) - prior * np.mean([loss(s, -1) for s in f_p])
    return prior * np.mean([loss(s, 1) for s in f_p]) + max(0.0, clean), clean


def test_training_lowers_the_non_negative_risk():
    rng = np.random.default_rng(0)
    positive = [np.flatnonzero(rng.random(12) < np.r_[np.full(6, 0.7), np.full(6, 0.3)]) for _ in range(200)]
    unlabelled = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(600)] + positive[:60]
    risks = []
    for steps in (1, 20, 150):
        m = toxicity.fit_nnpu(positive, unlabelled, 0.1, steps=steps)
        w = np.zeros(toxicity.BUCKETS)
        w[m.buckets] = m.weights
        risks.append(nn_risk(w, m.bias, positive, unlabelled, 0.1)[0])
    assert risks[0] > risks[1] > risks[2] and risks[2] < 0.9 * nn_risk(np.zeros(toxicity.BUCKETS), np.log(0.1 / 0.9), positive, unlabelled, 0.1)[0]


def test_ordinal_fit_is_near_the_most_likely_one():
    """No small change of a weight or a threshold raises the likelihood by much."""
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    latent = x @ np.array([3.0, -2.0, 0.0]) + rng.logistic(size=300)
    y = (latent > 0).astype(int) + (latent > 1.5)
    rows = [(np.arange(3, dtype=np.int32), r.astype(np.float32)) for r in x]
    m = quality.fit_ordinal(rows, y.tolist(), steps=800, rate=0.05, ridge=0.0)

    def likelihood(w, theta):
        tail = np.hstack([np.ones((300, 1)), 1 / (1 + np.exp(-(x @ w)[:, None] + theta)), np.zeros((300, 1))])
        return np.log(tail[np.arange(300), y] - tail[np.arange(300), y + 1]).mean()

    w, theta = m.weights[:3], m.thresholds
    assert theta[0] < theta[1]
    best = likelihood(w, theta)
    for i in range(3):
        for d in (-0.05, 0.05):
            assert likelihood(w + d * np.eye(3)[i], theta) < best + 1e-4
    for i in range(2):
        for d in (-0.05, 0.05):
            assert likelihood(w, theta + d * np.eye(2)[i]) < best + 1e-4


def test_every_language_has_a_landmark_and_can_be_predicted():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 1 << 22, 60)).astype(np.int32) for _ in range(200)]
    sets, names = [], []
    for _ in range(3):
        for i, grams in enumerate(own):
            sets.append(np.sort(rng.choice(grams, 40, replace=False)))
            names.append(f"l{i:03d}")
    model = langid.fit_kernel_ridge(sets, names)
    assert model.sizes.size == 200 if hasattr(model, "sizes") else model.coefficients.shape[0] == 200
    assert [model.languages[i] for i in model.scores(sets).argmax(axis=1)] == names


def test_ridge_solution_equals_a_dense_least_squares_solve():
    rng = np.random.default_rng(3)
    common = np.arange(200, dtype=np.int32)
    sets = [np.sort(rng.choice(common + 60 * (i % 3), 50, replace=False)).astype(np.int32) for i in range(60)]
    names = [("a", "b", "c", "a")[i % 3 if i % 7 else 3] for i in range(60)]
    model = langid.fit_kernel_ridge(sets, names, landmarks=12, ridge=0.01)
    kernel = model.kernel(sets).astype(np.float64)
    # The landmarks' own kernel, to express the ridge's penalty in the landmarks' coefficients.
    queues = [[i for i, x in enumerate(names) if x == n] for n in model.languages]
    chosen = [q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q)][:12]
    own = model.kernel([sets[i] for i in chosen]).astype(np.float64)
    root = np.linalg.cholesky(own + 1e-12 * np.eye(12))
    z = np.linalg.solve(root, kernel.T).T
    weight = np.array([1 / (len(model.languages) * names.count(x)) for x in names])
    y = np.where(np.array(names)[:, None] == np.array(model.languages), 1.0, -1.0)
    a = np.concatenate([np.sqrt(weight)[:, None] * np.c_[z, np.ones(60)], np.c_[np.sqrt(0.01) * np.eye(12), np.zeros(12)]])
    b = np.concatenate([np.sqrt(weight)[:, None] * y, np.zeros((12, len(model.languages)))])
    dense = np.linalg.lstsq(a, b, rcond=None)[0]
    assert kernel @ model.coefficients + model.offsets == pytest.approx(np.c_[z, np.ones(60)] @ dense, abs=1e-5)
