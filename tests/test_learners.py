import math

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.classification import LogisticRegressionWithSGD, SVMWithSGD
from pyspark.mllib.regression import LabeledPoint
import pytest
from pyspark.sql import functions as F

from textrill.config import SgdConfig
from textrill.operators import labelled, metrics, multiclass, mutual_info, naive_bayes, sgd, tfidf


def points(seed=3, rows=60, width=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width))
    return x, (x[:, 0] - x[:, 1] + rng.normal(scale=0.3, size=rows) > 0).astype(float)


def frame(spark, x, t):
    rows = [(i, [float(b)], [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, t))]
    return spark.createDataFrame(rows, "id INT, targets ARRAY<DOUBLE>, features ARRAY<DOUBLE>")


def test_logistic_steps_equal_the_library(spark):
    x, t = points()
    for step, iterations in ((0.1, 10), (1.0, 25)):
        cfg = SgdConfig(step=step, iterations=iterations)
        got = sgd.train(frame(spark, x, t), np.zeros((1, 5)), cfg)[0]
        data = spark.sparkContext.parallelize([LabeledPoint(b, a) for a, b in zip(x, t)], 2)
        want = LogisticRegressionWithSGD.train(data, iterations, step, initialWeights=np.zeros(5))
        assert np.allclose(got, want.weights.toArray(), atol=1e-9)


def test_hinge_steps_equal_the_library(spark):
    x, t = points(4)
    got = sgd.train(frame(spark, x, t), np.zeros((1, 5)), SgdConfig(loss="hinge", iterations=30))[0]
    data = spark.sparkContext.parallelize([LabeledPoint(b, a) for a, b in zip(x, t)], 2)
    want = SVMWithSGD.train(data, 30, initialWeights=np.zeros(5))
    assert np.allclose(got, want.weights.toArray(), atol=1e-9)


def test_models_share_passes_but_not_rows(spark):
    x, t = points(5)
    rows = frame(spark, x, t).withColumn(
        "targets", F.array(F.col("targets")[0], F.when(F.col("id") < 30, F.col("targets")[0]))
    )
    both = sgd.train(rows, np.zeros((2, 5)), SgdConfig(iterations=20))
    half = sgd.train(frame(spark, x[:30], t[:30]), np.zeros((1, 5)), SgdConfig(iterations=20))
    assert np.allclose(both[1], half[0], atol=1e-12)


def labelled_points(spark):
    rng = np.random.default_rng(8)
    centres = {"1": (3, 0, 0), "2": (0, 3, 0), "3": (0, 0, 3), "4": (-3, -3, -3)}
    rows = [
        (10 * i + k, y, [float(v) for v in np.array(centre) + rng.normal(scale=0.4, size=3)])
        for k, (y, centre) in enumerate(centres.items())
        for i in range(15)
    ]
    return spark.createDataFrame(rows, "id INT, y STRING, features ARRAY<DOUBLE>"), sorted(centres)


def test_cascade(spark):
    rows, labels = labelled_points(spark)
    model = multiclass.fit_cascade(rows, labels, SgdConfig(loss="hinge", iterations=30))
    assert model.weights.shape == (3, 3)
    sizes = multiclass.level_sizes(rows, labels).orderBy("level").collect()
    assert [(r["label"], r["rows"]) for r in sizes] == [("1", 60), ("2", 45), ("3", 30)]
    scored = multiclass.predict_cascade(model, rows)
    assert scored.where("y = pred").count() == 60


def test_pairs(spark):
    rows, labels = labelled_points(spark)
    model = multiclass.fit_pairs(rows, labels)
    assert len(model.pairs) == 6
    seven = multiclass.fit_pairs(rows, [str(i) for i in range(1, 8)])
    assert len(seven.pairs) == 21
    votes = multiclass.pair_votes(model, rows)
    assert votes.groupBy("id").count().where("count != 6").isEmpty()
    assert multiclass.predict_pairs(model, rows).where("y = pred").count() == 60


def test_vote_ties_go_to_the_lowest(spark):
    votes = [(1, "x", v) for v in ("c", "b", "b", "c", "a")]
    got = metrics.majority(spark.createDataFrame(votes, "id INT, y STRING, vote STRING")).first()
    assert got["pred"] == "b"


BITS = [("0", [1, 0, 1]), ("0", [1, 1, 0]), ("1", [0, 1, 1])]


def bit_docs(spark, rows=BITS):
    docs = [(i, y, "train", [f"t{j}" for j, b in enumerate(bits) if b]) for i, (y, bits) in enumerate(rows)]
    return spark.createDataFrame(docs, "id INT, y STRING, part STRING, tokens ARRAY<STRING>")


def test_naive_bayes_by_hand(spark):
    docs = bit_docs(spark)
    model = naive_bayes.fit(tfidf.word_set(docs, ["y", "part"]), docs)
    assert np.allclose(model.prior, [math.log(3 / 5), math.log(2 / 5)])
    theta = {(r["label"], r["term"]): r["theta"] for r in naive_bayes.theta_by_label(model).collect()}
    assert np.allclose([theta["0", f"t{j}"] for j in range(3)], np.log([3 / 7, 2 / 7, 2 / 7]))


def test_naive_bayes_equals_the_library(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i % 3), list((rng.random(12) < 0.3 + 0.2 * (i % 3)).astype(int))) for i in range(40)]
    rows += [("1", [0] * 12), ("2", [0] * 12)]
    docs = bit_docs(spark, rows)
    words = tfidf.word_set(docs, ["y", "part"])
    got = {r["id"]: r["pred"] for r in naive_bayes.predict(naive_bayes.fit(words, docs), words, docs).collect()}
    plain = spark.createDataFrame(
        [(i, float(y), [float(b) for b in bits]) for i, (y, bits) in enumerate(rows)],
        "id INT, label DOUBLE, x ARRAY<DOUBLE>",
    ).withColumn("features", array_to_vector("x"))
    want = NaiveBayes(smoothing=1.0).fit(plain).transform(plain).collect()
    assert any(sum(r["x"]) == 0 for r in want)
    assert all(got[r["id"]] == str(int(r["prediction"])) for r in want)


def test_weighted_scores(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    got = metrics.weighted_scores(spark.createDataFrame(pairs, "y STRING, pred STRING")).first()
    assert got["accuracy"] == 0.5 and got["rows"] == 4
    assert math.isclose(got["weighted_precision"], (2 * 1 + 1 / 3) / 4)
    assert math.isclose(got["weighted_recall"], 0.5)
    assert math.isclose(got["weighted_f1"], (2 * (2 / 3) + 0.5) / 4)


def test_drift_only_on_the_fall(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.6)], "batch INT, accuracy DOUBLE")
    assert [r["drift"] for r in metrics.drift(rows).orderBy("batch").collect()] == [False, True, False]


def test_topic_strength(spark):
    rows = [(1, "a", 0.5), (1, "a", 0.9), (1, "b", 0.6), (1, "b", 0.2)]
    got = metrics.topics(spark.createDataFrame(rows, "batch INT, pred STRING, prob DOUBLE"))
    assert {(r["topic"], r["rows"], r["strength"]) for r in got.collect()} == {("a", 2, 0.45), ("b", 2, 0.3)}


def test_batch_shaping(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id INT, y STRING")
    pairs = labelled.one_vs_rest(rows, ["a", "b"]).collect()
    assert sum(r["target"] for r in pairs) == 3 and len(pairs) == 6
    order = labelled.with_ordinal(rows, [F.desc("id")]).collect()
    assert {r["id"]: r["ordinal"] for r in order} == {3: 0, 2: 1, 1: 2}
    parts = labelled.random_parts(rows)
    assert sum(p.count() for p in parts) == 3
    try:
        labelled.pair_with_labels(rows, rows.limit(2))
    except ValueError:
        pass
    else:
        raise AssertionError("unequal counts must fail")


def test_mutual_information(spark):
    docs = spark.createDataFrame(
        [(1, "a", ["x", "x", "y"]), (2, "b", ["y"])], "id INT, y STRING, tokens ARRAY<STRING>"
    )
    got = {(r["y"], r["word"]): r["mi"] for r in mutual_info.word_weights(docs).collect()}
    want = {("a", "x"): 0.5 * math.log2(0.5 / (0.5 * 0.5)), ("a", "y"): 0.5, ("b", "y"): 0.5}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_pairing_needs_one_label_per_vector(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id long, x double")
    for ids in ((1, 9), (1, 1), (1, None)):
        with pytest.raises(ValueError, match="exactly one"):
            labelled.pair_with_labels(rows, spark.createDataFrame([(i, "a") for i in ids], "id long, y string"))
    assert labelled.pair_with_labels(rows, rows.select("id", F.lit("a").alias("y"))).count() == 2


def test_keyed_part_keeps_the_share(spark):
    for share in (0.7, 0.75, 0.125):
        part = spark.range(8000).select(labelled.keyed_part(share=share).alias("part"))
        assert part.where("part = 'train'").count() == 8000 * share
    with pytest.raises(ValueError, match="decimals"):
        labelled.keyed_part(share=1 / 3)


def test_a_text_is_predicted_alone_as_in_a_batch(spark):
    from textrill.config import TextConfig
    from textrill.plans.classifier import OnlineClassifier, train_batch
    from textrill.session import scratch_path

    rows = [(i, "ab"[i % 2], ("red apple pie " if i % 2 else "blue sky rain ") * (1 + i % 3) + f"w{i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "id BIGINT, y STRING, text STRING")
    path = scratch_path(spark, "saved")
    train_batch(docs, TextConfig(hash_buckets=None)).save_model(path)
    found = OnlineClassifier.load_model(spark, path)
    assert found.text == TextConfig()
    asked = spark.createDataFrame([(1, None, "red sky w1"), (2, None, "apple new new"), (3, None, "")], docs.schema)
    together = {r["id"]: (r["pred"], r["prob"]) for r in found.predict(asked).collect()}
    alone = {i: tuple(found.predict(asked.where(f"id = {i}")).select("pred", "prob").first()) for i in (1, 2, 3)}
    assert together == alone and alone[3][1] == 0.5
