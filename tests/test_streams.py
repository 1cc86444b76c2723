import numpy as np
import pytest
from pyspark.sql import functions as F

from textrill.config import SgdConfig, TextConfig
from textrill.operators import sgd
from textrill.plans import features, prequential
from textrill.plans.classifier import OnlineClassifier
from textrill.session import scratch_path
from textrill.sources import lines, records
from textrill.sources.model_store import ModelStore
from textrill.streaming import learning

TEXT = TextConfig(separator="[ \n]", cleaners=("clear", "characters"))


@pytest.fixture(scope="module")
def docs(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    return table.select(F.col("doc_id").alias("id"), F.col("lang").alias("y"), "text")


def test_stream_equals_batches(spark, docs):
    batch = ModelStore(spark, scratch_path(spark, "model"))
    parts = list(prequential.split_batches(docs, 3))
    prequential.run(batch, parts, features.featuriser(TEXT))
    stream = ModelStore(spark, scratch_path(spark, "model"))
    source, progress = scratch_path(spark, "arriving"), scratch_path(spark, "progress")
    for _, part in parts:
        part.write.mode("append").parquet(source)
        rows = lines.stream_table(spark, source, "id BIGINT, y STRING, text STRING")
        run = learning.prequential_stream(
            rows, stream, features.featuriser(TEXT), progress, available_now=True
        )
        run.awaitTermination()
    assert sorted(batch.metrics().collect()) == sorted(stream.metrics().collect())
    pick = ("id", "y", "pred")
    assert sorted(batch.read("predictions").select(*pick).collect()) == sorted(
        stream.read("predictions").select(*pick).collect()
    )


def test_ranges_cover_the_table_once(spark, docs):
    parts = list(prequential.split_batches(docs, 7))
    assert sum(part.count() for _, part in parts) == docs.count()
    named = prequential.with_batch(docs, 7)
    for batch_id, part in parts:
        assert {r["id"] for r in part.select("id").collect()} == {
            r["id"] for r in named.where(F.col("batch") == batch_id).select("id").collect()
        }


def test_growing_vectors(spark, docs):
    store = ModelStore(spark, scratch_path(spark, "model"))
    base = spark.createDataFrame(
        [("the", [1.0] * 8, "base"), ("de", [-1.0] * 8, "base")],
        "word STRING, vec ARRAY<FLOAT>, origin STRING",
    )
    run = learning.growing_vectors(store, base, TextConfig("[ \n]", ("clear", "characters"), vector_size=8))
    parts = list(prequential.split_batches(docs, 3))
    prequential.run(store, parts, run)
    added = store.read("added_words").persist()
    assert added.where("batch = 0").isEmpty() and not added.where("batch = 1").isEmpty()
    assert added.groupBy("word").count().where("count > 1").isEmpty()
    assert added.join(base, "word").isEmpty()
    assert added.where(F.size("vec") != 8).isEmpty()
    assert store.metrics().count() == 2
    vectors = {r["word"]: r["vec"] for r in added.where("batch = 2").collect()}
    added.unpersist()
    prequential.step(store, parts[2][1], 2, run)
    again = store.read("added_words").where("batch = 2")
    assert {r["word"]: r["vec"] for r in again.collect()} == vectors
    online = OnlineClassifier(spark, store.root, run)
    assert online.predict(parts[0][1]).count() == parts[0][1].count()
    assert store.versions("added_words") == [1, 2]


def test_lines_get_ids_and_stay_apart(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("a b\t1",), ("a b\t1",), ("c\t2",), ("short",)], "v STRING").write.text(path)
    named = lines.read_lines(spark, path).select("value", F.col("_metadata.file_path").alias("file"))
    ids = sorted(lines.with_ids(named).collect())
    assert len({r["id"] for r in ids}) == 4
    assert sorted(lines.with_ids(named.repartition(3)).collect()) == ids
    store = ModelStore(spark, scratch_path(spark, "model"))
    learning.line_step(store, named, 0, features.featuriser(TEXT))
    learning.line_step(store, named, 1, features.featuriser(TEXT))
    assert store.read("predictions").count() == 3
    assert [r["value"] for r in store.read("rejects").where("batch = 1").collect()] == ["short"]


def test_predictions_on_a_stream_follow_the_model(spark, docs):
    online = OnlineClassifier(spark, featurise=features.featuriser(TEXT))
    source, sink = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    progress, want = scratch_path(spark, "progress"), []
    for batch_id, part in prequential.split_batches(docs, 2):
        online.train(part)
        part.write.mode("append").parquet(source)
        rows = lines.stream_table(spark, source, "id BIGINT, y STRING, text STRING")
        online.predict_stream(rows, progress, sink, available_now=True).awaitTermination()
        want += [(batch_id, r["id"], r["pred"]) for r in online.predict(part).collect()]
    got = spark.read.parquet(sink).select("batch", "id", "pred").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert online.store.metrics().isEmpty() and online.store.versions("predictions") == []


def test_streaming_logistic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    rows = [(i, float(a[0] > 0), [float(v) for v in a]) for i, a in enumerate(x)]
    table = spark.createDataFrame(rows, "id BIGINT, y DOUBLE, features ARRAY<DOUBLE>")
    cfg = SgdConfig(step=1.0, iterations=5)
    model = learning.StreamingLogistic(spark, scratch_path(spark, "model"), cfg)
    with pytest.raises(ValueError):
        model.latest_model()
    model.set_initial_weights([0.0] * 3)
    halves = [table.where("id < 15"), table.where("id >= 15")]
    for batch_id, part in enumerate(halves):
        model.train_batch(part, batch_id)
    model.train_batch(table.where("false"), 2)
    w = np.zeros((1, 3))
    for part in halves:
        prepared = part.select("id", F.array("y").alias("targets"), "features")
        w = sgd.train(prepared, w, cfg)
    assert np.allclose(model.latest_model(), w[0], atol=1e-12)
    got = {r["id"]: r["prob"] for r in model.predict_on(table).collect()}
    want = 1 / (1 + np.exp(-(x @ w[0])))
    assert all(abs(got[i] - p) < 1e-12 for i, p in enumerate(want))
    model.train_batch(halves[1], 1)
    assert np.allclose(model.latest_model(), w[0], atol=1e-12)


def test_short_lines_are_rejects(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([("a b\t1",), ("no label",), ("empty\t",), ("\t2",)], "v STRING").write.text(path)
    rows, rejects = lines.parse_labelled(lines.read_lines(spark, path))
    assert sorted((r["text"], r["y"]) for r in rows.collect()) == [("", "2"), ("a b", "1")]
    assert sorted(r["value"] for r in rejects.collect()) == ["empty\t", "no label"]


def test_missing_stop_word_file_is_an_empty_list(spark):
    assert lines.read_stop_words(spark, scratch_path(spark, "nothing")).isEmpty()


def test_records_have_a_null_key(spark):
    path = scratch_path(spark, "records")
    records.write_records(spark.createDataFrame([("x",)], "value STRING"), format="parquet", path=path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(None, "x")]
