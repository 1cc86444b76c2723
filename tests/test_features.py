import math

import pytest
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

from textrill.config import JoinPolicy
from textrill.operators import joins, tfidf, wordvec
from textrill.session import scratch_path


def tokens(spark, *texts):
    rows = [(i, "y", list(text)) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "id INT, y STRING, tokens ARRAY<STRING>")


def test_idf_of_two_documents(spark):
    got = tfidf.inverse_document_frequency(tokens(spark, ["a", "b"], ["a"])).collect()
    idf = {row["idx"]: row["idf"] for row in got}
    assert idf["a"] == 0.0
    assert math.isclose(idf["b"], 0.4054651081, rel_tol=1e-9)


@pytest.mark.parametrize("buckets", [None, 1 << 10])
@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_tfidf_keeps_texts_without_terms(spark, buckets, bytes_):
    docs = tokens(spark, ["a", "b", "a"], [], ["c"])
    rows = tfidf.tfidf(docs, buckets, ["y"], JoinPolicy(broadcast_bytes=bytes_)).collect()
    empty = [row for row in rows if row["id"] == 1]
    assert [(row["idx"], row["v"]) for row in empty] == [(None, 0.0)]
    values = sorted(round(row["v"], 9) for row in rows if row["id"] == 0)
    assert values == [round(math.log(2), 9), round(2 * math.log(2), 9)]


def test_idf_is_fitted_per_batch(spark):
    docs = tokens(spark, ["a"], ["a", "b"]).withColumn("batch", F.col("id"))
    rows = {(r["batch"], r["idx"]): r["v"] for r in tfidf.tfidf_by_batch(docs).collect()}
    assert rows == {(0, "a"): 0.0, (1, "a"): 0.0, (1, "b"): 0.0}


WORDS = [("a", [1.0, 2.0], "base"), ("b", [3.0, -2.0], "base")]


def vectors(spark):
    return spark.createDataFrame(WORDS, "word STRING, vec ARRAY<FLOAT>, origin STRING")


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_unknown_words_count_in_the_divisor(spark, bytes_):
    docs = tokens(spark, ["a", "unknown"], [], ["b", "a", "b"], ["x", "y"])
    policy = JoinPolicy(broadcast_bytes=bytes_)
    got = wordvec.document_vectors(docs, vectors(spark), 2, ["y"], policy).collect()
    want = {0: [0.5, 1.0], 1: [0.0, 0.0], 2: [7 / 3, -2 / 3], 3: [0.0, 0.0]}
    assert {row["id"]: row["features"] for row in got} == want


def test_unfamiliar_texts_share_no_word(spark):
    docs = tokens(spark, ["a", "x"], ["x", "y"], [], ["y", "y"])
    got = wordvec.unfamiliar_texts(docs, vectors(spark))
    assert sorted(row["id"] for row in got.collect()) == [1, 2, 3]
    order = wordvec.indexed_vocabulary(got).orderBy("position").collect()
    assert [(r["word"], r["cn"], r["position"]) for r in order] == [("y", 3, 0), ("x", 1, 1)]


def test_first_vector_of_a_word_stays(spark):
    new = [("b", [9.0, 9.0], "added"), ("c", [5.0, 5.0], "added")]
    new = spark.createDataFrame(new, "word STRING, vec ARRAY<FLOAT>, origin STRING")
    got = wordvec.merge_vectors(vectors(spark), new).collect()
    assert {(r["word"], r["origin"], r["vec"][0]) for r in got} == {
        ("a", "base", 1.0), ("b", "base", 3.0), ("c", "added", 5.0)
    }


def test_trained_vectors(spark):
    docs = tokens(spark, *[["red", "green", "blue"]] * 20, *[["one", "two"]] * 20)
    table = wordvec.train_word_vectors(docs, 10, min_count=1)
    assert table.count() == 5 and table.where(F.size("vec") != 10).isEmpty()
    assert table.where(F.exists("vec", lambda v: F.isnan(v))).isEmpty()
    base = table.where("word IN ('one', 'two')")
    new = wordvec.train_new_words(docs, base, 10)
    assert {row["word"] for row in new.collect()} == {"red", "green", "blue"}
    assert wordvec.train_new_words(docs, table, 10) is None


def test_training_keeps_all_words_and_follows_the_data(spark, monkeypatch):
    tasks = []

    def spied(**settings):
        tasks.append(settings["numPartitions"])
        return Word2Vec(**settings)

    monkeypatch.setattr(wordvec, "Word2Vec", spied)
    monkeypatch.setattr(wordvec, "TASK_TOKENS", 20)
    docs = tokens(spark, *[["red", "green", "blue"]] * 20, ["once"], [])
    got = wordvec.train_word_vectors(docs, 4)
    assert {r["word"] for r in got.collect()} == {"red", "green", "blue", "once"}
    wordvec.train_word_vectors(docs.limit(3), 4)
    new = wordvec.train_new_words(docs, got.where("word = 'once'"), 4)
    assert {r["word"] for r in new.collect()} == {"red", "green", "blue"} and tasks == [4, 1, 3]
    bound = 3 * wordvec.word_bytes(4)
    assert wordvec.train_new_words(docs, got.where("word = 'once'"), 4, driver_bytes=bound).count() == 3
    with pytest.raises(ValueError, match="4 words"):
        wordvec.train_word_vectors(docs, 4, driver_bytes=bound)
    with pytest.raises(ValueError, match="4 words"):
        wordvec.train_new_words(docs, got.limit(0), 4, driver_bytes=bound)
    assert len(tasks) == 4


def test_saved_vectors_and_saved_models_load(spark):
    docs = tokens(spark, *[["red", "green"]] * 10)
    model = Word2Vec(vectorSize=4, minCount=1, inputCol="tokens", outputCol="v").fit(docs)
    path = scratch_path(spark, "model")
    model.save(path)
    assert {r["word"] for r in wordvec.load_word_vectors(spark, path).collect()} == {"red", "green"}
    table = scratch_path(spark, "vectors")
    vectors(spark).write.parquet(table)
    assert sorted(wordvec.load_word_vectors(spark, table).collect()) == sorted(vectors(spark).collect())


def test_hot_key_is_split_and_nothing_lost(spark):
    left = spark.range(9000).select(
        "id", F.expr("CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN CAST(id AS STRING) END").alias("k")
    )
    right = left.select("k").distinct().where("k IS NOT NULL").withColumn("w", F.length("k"))
    policy = JoinPolicy(broadcast_bytes=0, hot_share=0.01)
    hot = joins.hot_keys(left, "k", policy).collect()
    assert [(row["k"], row["_pieces"]) for row in hot] == [("hot", 34)]
    split = joins.lookup_join(
        left, right, "k", right_rows=4000, row_bytes=100, spread=F.col("id"), policy=policy
    )
    plain = left.join(right, "k", "left")
    assert sorted(split.collect(), key=str) == sorted(plain.select(*split.columns).collect(), key=str)
    assert split.count() == 9000
