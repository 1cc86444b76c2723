"""The block path of FTRL against the rows and the joins, on texts made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrill.config import JoinPolicy, TextConfig
from textrill.operators import ftrl, ftrl_blocks, ftrl_rows
from textrill.plans import features, prequential
from textrill.plans.classifier import train_batch
from textrill.session import scratch_path
from textrill.sources import lines
from textrill.sources.model_store import ModelStore
from textrill.streaming import learning

TEXT = TextConfig(separator="[ \n]", cleaners=("clear", "characters"))


def texts(seed, rows=60, labels=("a", "b", "c"), turned=False):
    """Texts whose first word tells the label; some without label or text, and ids that repeat."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        k = int(rng.integers(len(labels)))
        words = [f"of{k}", *(f"w{w}" for w in rng.integers(0, 40, rng.integers(0, 12))), "all", "all"]
        label = labels[(k + 1) % len(labels)] if turned else labels[k]
        out.append((100 * seed + i - i % 7 % 2, None if i % 11 == 5 else label, None if i % 13 == 4 else " ".join(words)))
    return out


def batches(spark):
    given = [texts(1), texts(2), texts(3, labels=("a", "d", "b"), turned=True)]
    return [(b, spark.createDataFrame(rows, "id BIGINT, y STRING, text STRING")) for b, rows in enumerate(given)]


def found(store):
    state = ftrl.state_by_label(store.latest().state, store.latest().labels).collect()
    return (
        {(r["label"], r["idx"]): (r["z"], r["n"], r["w"]) for r in state},
        sorted(((r["batch"], r["id"], str(r["y"]), r["pred"], r["prob"]) for r in store.read("predictions").collect())),
        sorted(map(tuple, store.metrics().collect())),
        sorted((r["batch"], r["idx"], r["idf"], r["texts"]) for r in store.read("idf").collect()),
    )


def run(spark, text):
    store = ModelStore(spark, scratch_path(spark, "model"))
    for batch_id, batch in batches(spark):
        prequential.step(store, batch, batch_id, features.featuriser(text), keep_idf=True)
    return store


def test_blocks_give_what_rows_give_and_nothing_of_the_state_at_the_caller(spark, monkeypatch):
    want = run(spark, TEXT)
    monkeypatch.setattr(ftrl_blocks, "LARGE_TEXT", -1)
    monkeypatch.setattr(ftrl_blocks, "PART_BYTES", 1000)  # several parts a task
    monkeypatch.setattr(ftrl_blocks, "OFF_BYTES", 1000)  # several groups of blocks in a pass
    for name in ("state_of", "positions", "train", "term_statistics"):
        monkeypatch.setattr(ftrl_rows, name, None)
    got = run(spark, TEXT)
    assert got.latest().labels == want.latest().labels == ["a", "b", "c", "d"]
    assert got.latest().state_rows == want.latest().state_rows
    (state, scored, scores, idf), (state_, scored_, scores_, idf_) = found(got), found(want)
    assert state.keys() == state_.keys() and all(np.allclose(state[k], state_[k], atol=1e-9) for k in state_)
    assert [r[:4] for r in scored] == [r[:4] for r in scored_]
    assert np.allclose([r[4] for r in scored], [r[4] for r in scored_])
    assert scores == scores_ and any(r[4] for r in scores)  # one drifted, and was trained twice
    assert [(r[0], r[1], r[3]) for r in idf] == [(r[0], r[1], r[3]) for r in idf_] and np.allclose([r[2] for r in idf], [r[2] for r in idf_])


def test_lines_of_a_large_batch_go_by_blocks(spark, monkeypatch, tmp_path):
    def scores():
        store = ModelStore(spark, scratch_path(spark, "model"))
        for b, batch in batches(spark):
            if not (tmp_path / str(b)).exists():
                lines.write_labelled(batch, str(tmp_path / str(b)))
            named = lines.read_lines(spark, str(tmp_path / str(b))).select("value", F.col("_metadata.file_path").alias("file"))
            learning.line_step(store, named, b, features.featuriser(TEXT))
        return sorted(map(tuple, store.metrics().collect()))

    want = scores()
    monkeypatch.setattr(ftrl_blocks, "LARGE_TEXT", -1)
    monkeypatch.setattr(ftrl_rows, "state_of", None)
    assert scores() == want and len(want) == 2


def test_lines_of_a_batch_are_read_and_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(ftrl_blocks, "LARGE_TEXT", -1)
    read = spark.sparkContext.accumulator(0)

    def counting(found):
        for batch in found:
            read.add(batch.num_rows)
            yield batch

    given = [(f"w{i} all\t{'ab'[i % 2]}", "f") for i in range(20)] + [("short", "f")]
    named = spark.createDataFrame(given, "value STRING, file STRING").mapInArrow(counting, "value STRING, file STRING")
    store = ModelStore(spark, scratch_path(spark, "model"))
    learning.line_step(store, named, 0, features.featuriser(TEXT))
    assert read.value == len(given) and store.read("rejects").count() == 1


def test_empty_batches_and_batches_without_labels_or_words(spark, monkeypatch):
    monkeypatch.setattr(ftrl_blocks, "LARGE_TEXT", -1)
    store, run_ = ModelStore(spark, scratch_path(spark, "model")), features.featuriser(TEXT)

    def step(b, rows):
        return prequential.step(store, spark.createDataFrame(rows, "id BIGINT, y STRING, text STRING"), b, run_)

    assert step(0, []) is None and step(0, [(1, None, "x y")]) is None
    assert step(0, [(1, "a", "x y"), (2, "b", "")]).labels == ["a", "b"]
    assert step(1, [(1, "a", None), (2, "b", "  ")]).score.rows == 2
    assert step(2, [(1, None, "x"), (2, None, "new")]).score.rows == 0


@pytest.mark.parametrize("buckets", [None, 64])
def test_a_large_batch_is_predicted_by_blocks(spark, monkeypatch, buckets):
    model = train_batch(batches(spark)[0][1], TextConfig(separator="[ \n]", cleaners=("clear", "characters"), hash_buckets=buckets))
    new = batches(spark)[1][1]
    want = {(r["id"], r["y"]): r for r in model.predict(new).collect()}
    monkeypatch.setattr(ftrl_blocks, "LARGE_TEXT", -1)
    rows = model.predict(new)
    assert "FlatMapCoGroupsInArrow" in rows._jdf.queryExecution().toString() and "Generate" not in rows._jdf.queryExecution().toString()
    got = {(r["id"], r["y"]): r for r in rows.collect()}
    assert got.keys() == want.keys() and len(got) < new.count()
    assert all(got[k]["pred"] == want[k]["pred"] and abs(got[k]["prob"] - want[k]["prob"]) < 1e-9 for k in want)
