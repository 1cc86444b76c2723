import numpy as np
import pytest
from pyspark.sql import functions as F

from textrill.config import FtrlConfig, JoinPolicy, TextConfig
from textrill.operators import ftrl, ftrl_rows
from textrill.plans import features, prequential
from textrill.plans.classifier import OnlineClassifier
from textrill.session import scratch_path
from textrill.sources.model_store import ModelStore

from . import brute

SCHEMA = "id BIGINT, y STRING, features ARRAY<DOUBLE>"
BROADCAST = FtrlConfig()
SHUFFLED = FtrlConfig(join=JoinPolicy(broadcast_bytes=0, hot_share=0.05), label_chunk=2)


def table(spark, x, y, start=0):
    rows = [(start + i, label, [float(v) for v in row]) for i, (row, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA)


def data(seed, rows=40, width=6, labels=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width)) * (rng.random((rows, width)) < 0.6)
    return x, [labels[i] for i in rng.integers(0, len(labels), rows)]


def state_of(model):
    rows = ftrl.state_by_label(model.state, model.labels).collect()
    return {(r["label"], r["idx"]): (r["z"], r["n"], r["w"]) for r in rows}


def agrees(got, want):
    for label, (z, n) in want.items():
        w = brute.weight(z, n)
        for idx in range(len(z)):
            found = got.get((label, idx), (0.0, 0.0, 0.0))
            assert np.allclose(found, (z[idx], n[idx], w[idx]), atol=1e-9)


def sparse(batch, batch_id):
    return ftrl.dense_features(batch).where("v != 0")


@pytest.mark.parametrize("cfg", [BROADCAST, SHUFFLED])
@pytest.mark.parametrize("featurise", [features.dense, sparse])
def test_three_batches_equal_a_replay(spark, cfg, featurise):
    batches = [data(1), data(2, labels=("a", "d")), data(3, labels=("b", "c", "d"))]
    store = ModelStore(spark, scratch_path(spark, "model"))
    prequential.run(
        store, [(b, table(spark, x, y, 100 * b)) for b, (x, y) in enumerate(batches)], featurise, cfg
    )
    scores, state, labels = brute.prequential(batches)
    model = store.latest()
    assert model.labels == labels == ["a", "b", "c", "d"]
    assert model.first_batch == [0, 0, 0, 1]
    agrees(state_of(model), state)
    rows = store.metrics().orderBy("batch").collect()
    assert [(round(r["accuracy"], 9), r["drift"]) for r in rows] == [
        (round(a, 9), d) for a, d in scores
    ]


def test_drift_trains_twice(spark):
    x, y = data(5, rows=60, labels=("a", "b"))
    easy = (x, ["a" if row[0] + row[1] > 0 else "b" for row in x])
    turned = (x, ["b" if label == "a" else "a" for label in easy[1]])
    batches = [easy, easy, turned, easy]
    store = ModelStore(spark, scratch_path(spark, "model"))
    prequential.run(
        store, [(b, table(spark, x, y)) for b, (x, y) in enumerate(batches)], features.dense
    )
    scores, state, _ = brute.prequential(batches)
    assert [drift for _, drift in scores][1] is True
    rows = store.metrics().orderBy("batch").collect()
    assert [r["drift"] for r in rows] == [drift for _, drift in scores]
    agrees(state_of(store.latest()), state)


def test_first_pass_from_zero(spark):
    feats = ftrl.by_text(ftrl.dense_features(table(spark, [[2.0, -1.0]], ["a"])), 1).persist()
    empty = ftrl.empty_state(spark, feats.schema["idx"].dataType)
    state = ftrl.train(feats, empty, 0, ["a"], passes=1)
    rows = {r["idx"]: (r["z"][0], r["n"][0]) for r in state.collect()}
    assert rows == {0: (-1.0, 1.0), 1: (0.5, 0.25)}
    feats.unpersist()


def test_ties_go_to_the_first_label(spark):
    margin = spark.createDataFrame([(1, "b", [0.0, 0.0, -1.0])], "id INT, y STRING, margin ARRAY<DOUBLE>")
    best = ftrl.best_label(margin, ["b", "a", "c"]).first()
    assert (best["pred"], best["prob"]) == ("b", 0.5)


def test_saturated_rows_are_ranked_by_margin(spark):
    margin = spark.createDataFrame([(1, "b", [800.0, 900.0])], "id INT, y STRING, margin ARRAY<DOUBLE>")
    best = ftrl.best_label(margin, ["a", "b"]).first()
    assert (best["pred"], best["prob"]) == ("b", 1.0)


def test_probabilities(spark):
    margin = spark.createDataFrame([(1, "a", [0.0, 5.0])], "id INT, y STRING, margin ARRAY<DOUBLE>")
    two = {r["label"]: r["prob"] for r in ftrl.label_probabilities(margin, ["a", "b"]).collect()}
    assert two == {"a": 0.5, "b": 0.5}
    wide = margin.withColumn("margin", F.array(F.lit(0.0), F.lit(0.0), F.lit(-800.0)))
    three = {r["label"]: r["prob"] for r in ftrl.label_probabilities(wide, ["a", "b", "c"]).collect()}
    assert three == {"a": 0.5, "b": 0.5, "c": 0.0}


def test_a_batch_run_again_changes_nothing(spark):
    store = ModelStore(spark, scratch_path(spark, "model"))
    parts = [table(spark, *data(seed)) for seed in (1, 2)]
    for batch_id, part in enumerate(parts):
        prequential.step(store, part, batch_id, features.dense)
    before, scored = state_of(store.latest()), sorted(store.read("predictions").collect())
    prequential.step(store, parts[1], 1, features.dense)
    again = state_of(store.latest())
    assert before.keys() == again.keys()
    assert all(np.allclose(before[k], again[k], atol=1e-12) for k in before)
    assert [r["id"] for r in sorted(store.read("predictions").collect())] == [r["id"] for r in scored]


def test_empty_batch_is_skipped(spark):
    store = ModelStore(spark, scratch_path(spark, "model"))
    part = table(spark, *data(1))
    assert prequential.step(store, part.where("false"), 0, features.dense) is None
    assert store.is_empty()
    prequential.step(store, part, 1, features.dense)
    prequential.step(store, part.where("false"), 2, features.dense)
    prequential.step(store, part, 3, features.dense)
    assert store.versions() == [1, 3]
    assert [r["batch"] for r in store.metrics().collect()] == [3]


def test_rows_without_a_label_are_scored_and_teach_nothing(spark):
    x, y = data(5)
    plain, mixed = (ModelStore(spark, scratch_path(spark, "model")) for _ in range(2))
    both = table(spark, x, y).unionAll(table(spark, x[:7], [None] * 7, start=1000))
    for batch_id in range(2):
        prequential.step(plain, table(spark, x, y), batch_id, features.dense)
        prequential.step(mixed, both, batch_id, features.dense)
    one, two = plain.load(1), mixed.load(1)
    assert one.labels == two.labels and one.score == two.score
    a, b = (state_of(m) for m in (one, two))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert mixed.read("predictions").where("id >= 1000 AND pred IS NOT NULL").count() == 7
    empty = ModelStore(spark, scratch_path(spark, "model"))
    assert prequential.step(empty, table(spark, x[:7], [None] * 7), 0, features.dense) is None


def test_text_without_features_is_still_scored(spark):
    store = ModelStore(spark, scratch_path(spark, "model"))
    prequential.step(store, table(spark, *data(1)), 0, features.dense)
    prequential.step(store, table(spark, [[]], ["c"]), 1, features.dense)
    row = store.read("predictions").first()
    assert (row["pred"], row["prob"]) == ("a", 0.5)


def test_save_and_load(spark):
    online = OnlineClassifier(spark)
    assert online.is_empty()
    with pytest.raises(ValueError):
        online.predict(table(spark, *data(1)))
    online.train(table(spark, *data(1)))
    path = scratch_path(spark, "saved")
    online.save_model(path)
    loaded = OnlineClassifier.load_model(spark, path)
    assert state_of(loaded.model()) == state_of(online.model())
    assert loaded.cfg == online.cfg
    rows = table(spark, *data(2))
    assert sorted(loaded.predict(rows).collect()) == sorted(online.predict(rows).collect())
    one = loaded.store.submodel("b").collect()
    assert {r["idx"]: r["z"] for r in one} == {
        idx: z for (label, idx), (z, _, _) in state_of(online.model()).items() if label == "b"
    }
    with pytest.raises(KeyError):
        loaded.store.submodel("zz")


def test_passes_need_no_exchange_of_the_texts(spark):
    feats = ftrl.by_text(ftrl.dense_features(table(spark, *data(1))), 1000).persist()
    feats.count()
    empty = ftrl.empty_state(spark, feats.schema["idx"].dataType)
    plan = ftrl.train(feats, empty, 0, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    live = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # the only shuffles by text are those inside the cached table
    assert all("idx" in line for line in live if "REPARTITION" not in line)
    feats.unpersist()


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_batch_of_rows_takes_few_jobs_and_no_joins_or_explodes(spark, monkeypatch):
    plans = []
    passes = ftrl_rows.pass_sums

    def watched(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return passes(rows, *rest)

    monkeypatch.setattr(ftrl_rows, "pass_sums", watched)
    store, joined = (ModelStore(spark, scratch_path(spark, "model")) for _ in range(2))
    batches = [table(spark, *data(seed), 100 * seed).cache() for seed in (1, 2)]
    prequential.step(store, batches[0], 0, features.dense)
    prequential.step(joined, batches[0], 0, sparse)
    few = jobs(spark, "rows", lambda: prequential.step(store, batches[1], 1, features.dense))
    many = jobs(spark, "joined", lambda: prequential.step(joined, batches[1], 1, sparse))
    assert few <= 13 and few < 0.65 * many, (few, many)
    assert len(plans) == 6 and not any(word in plan for plan in plans for word in ("Generate", "Window", "Join", "Exchange"))
    agrees(state_of(store.latest()), {label: (z, n) for label, (z, n) in brute.prequential([data(1), data(2)])[1].items()})


def test_versions_hold_what_their_batch_changed(spark, monkeypatch):
    from textrill.sources import model_store

    monkeypatch.setattr(model_store, "COMPACT", 3)
    cfg = TextConfig()
    texts = [["a b c", "a d"], ["a e", "e f"], ["g h", "a g"], ["b a", "h h"], ["i", "j a"], ["k", "a"]]
    store, whole = (ModelStore(spark, scratch_path(spark, "model")) for _ in range(2))
    shuffled = FtrlConfig(join=JoinPolicy(broadcast_bytes=0, hot_share=0.05))
    for k, pair in enumerate(texts):
        batch = spark.createDataFrame([(2 * k + i, "xy"[i], t) for i, t in enumerate(pair)], "id BIGINT, y STRING, text STRING")
        model = prequential.step(store, batch, k, features.featuriser(cfg))
        other = prequential.step(whole, batch, k, features.featuriser(cfg), shuffled)
        written = spark.read.parquet(store.path("weights", k)).count()
        terms = len({t for s in pair for t in s.split(" ")})
        assert model.base == (3 if k >= 3 else 0)
        assert written == (model.state_rows if model.base == k else terms) and model.state_rows == other.state_rows
        got, want = state_of(store.latest()), state_of(other)
        assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-9) for c in got)
