"""Test-then-train over batches (P3, P4). One step serves batch tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textrill.config import FtrlConfig
from textrill.operators import ftrl, ftrl_blocks, ftrl_rows, metrics, tfidf
from textrill.operators.joins import MOST_TEXTS, TEXTS_PER_PARTITION, partitions
from textrill.sources.model_store import Model, ModelStore, Score

Featurise = Callable[[DataFrame, int], DataFrame]

# texts that one task passes over faster than several exchange their sums
FEW_TEXTS = 10 * TEXTS_PER_PARTITION


def step(
    store: ModelStore,
    batch: DataFrame,
    batch_id: int,
    featurise: Featurise,
    cfg: FtrlConfig = FtrlConfig(),
    scored: bool = True,
    keep_idf: bool = False,
) -> Model | None:
    """Score one batch with the model before it, then train on it.

    Predictions and metrics of the batch are written before the new state, and everything is
    read from the version before ``batch_id``, so running a batch again changes nothing. If
    accuracy fell by more than ``drift_drop``, the batch is trained a second time. An empty
    batch is skipped. Rows without a label are scored, and left out of training and accuracy;
    a batch of such rows alone, with no model before it, is skipped too. With ``scored`` off
    the batch is trained on once, and there are no predictions, metrics or drift.

    Where the featuriser gives a row per text and the batch's coordinates are within the broadcast bound, their state
    goes to the rows (``ftrl_rows``); otherwise the features meet the state in joins. Texts of more than ``LARGE_TEXT`` bytes and
    at most ``label_chunk`` labels go by blocks (``ftrl_blocks``). With ``keep_idf`` the batch's IDF is
    written as a version of the table ``idf``, before the model, for predictions with this version (S11).
    """
    vectors, terms = (getattr(featurise, name, None) for name in ("vectors", "terms"))
    if vectors or terms:
        if terms:
            found = ftrl_blocks.sizes(batch)
            batch = _spread(batch, sum(rows for rows, _ in found.values()))
            text_bytes = sum(b for _, b in found.values())
            if text_bytes > ftrl_blocks.LARGE_TEXT:
                prior = store.latest(before=batch_id)
                labels = ftrl.known_labels(prior.labels if prior else [], found)
                if not labels:
                    return None
                if len(labels) <= cfg.label_chunk:
                    size = sum(rows for rows, _ in found.values())
                    return _block_step(store, batch, batch_id, featurise, cfg, scored, keep_idf, prior, labels, size, text_bytes)
        rows = vectors(batch, batch_id) if vectors else terms(batch, batch_id)
        rows.persist()
        try:
            return _row_step(store, rows, batch_id, cfg, scored, bool(terms), keep_idf)
        except TooWide:
            pass  # the same batch by way of joins
        finally:
            rows.unpersist()
    size = batch.count()
    if size == 0:
        return None
    if keep_idf:
        docs = featurise.tokens(batch)
        found = tfidf.inverse_document_frequency(docs, featurise.buckets, texts=size).select("idx", "idf")
        store.write("idf", batch_id, found.withColumn("texts", F.lit(size).cast("long")))
    # kept spread by text: the featuriser and all passes work on these partitions
    texts = batch.repartition(partitions(batch, size), "id").persist()
    feats = ftrl.by_text(featurise(texts, batch_id), size).persist()
    try:
        by_label = ftrl.label_rows(feats)
        texts.unpersist()
        prior = store.latest(before=batch_id)
        score = _score(store, feats, prior, batch_id, cfg) if prior and scored else Score()
        passes = 2 * cfg.passes if score.drift else cfg.passes
        known = prior.labels if prior else []
        labels = ftrl.known_labels(known, by_label)
        if not labels:
            return None
        index_type = feats.schema["idx"].dataType
        state = ftrl.train(
            feats,
            prior.state if prior else ftrl.empty_state(store.spark, index_type),
            prior.state_rows if prior else 0,
            labels,
            cfg,
            passes,
            sum(rows for label, rows in by_label.items() if label is not None),
        )
        first = (prior.first_batch if prior else []) + [batch_id] * (len(labels) - len(known))
        return store.commit(batch_id, state, labels, first, cfg, score)
    finally:
        texts.unpersist()
        feats.unpersist()


def _spread(batch: DataFrame, size: int) -> DataFrame:
    """A small batch dealt out to as many tasks as it is worth; a large one stays in those that read it."""
    parts = partitions(batch, size)
    return batch.repartition(parts) if size <= MOST_TEXTS else batch


class TooWide(Exception):
    """A batch touches more coordinates than may live with the caller."""


def _row_step(
    store: ModelStore, rows: DataFrame, batch_id: int, cfg: FtrlConfig, scored: bool, terms: bool, keep_idf: bool
) -> Model | None:
    """One batch of kept rows; ``terms`` says that they hold terms, whose counts take the IDF of this batch."""
    width = F.lit(0) if terms else F.max(F.size("v"))
    counted = rows.groupBy("y").agg(F.count("*").alias("rows"), width.alias("width")).collect()  # a row per label
    size = sum(r["rows"] for r in counted)
    if size == 0:
        return None
    prior = store.latest(before=batch_id)
    known = prior.labels if prior else []
    labels = ftrl.known_labels(known, (r["y"] for r in counted))
    if not labels:
        return None
    if terms:
        stats = ftrl_rows.term_statistics(rows).persist()
        try:
            if not ftrl_rows.fits(*stats.agg(F.count("*"), F.sum(F.octet_length(F.col("idx").cast("string")))).first(), len(labels), cfg):
                raise TooWide
            found = stats.toArrow()
        finally:
            stats.unpersist()
        keys = found["idx"].combine_chunks()
        idf = np.log((size + 1.0) / (found["df"].to_numpy() + 1.0))
        if keep_idf:
            frame = store.spark.createDataFrame(pa.Table.from_arrays([keys, pa.array(idf)], ["idx", "idf"]))
            store.write("idf", batch_id, frame.withColumn("texts", F.lit(size).cast("long")))
    else:
        keys = pa.array(range(max(0, *(r["width"] or 0 for r in counted))), pa.int32())
        if not ftrl_rows.fits(len(keys), 4 * len(keys), len(labels), cfg):
            raise TooWide
    state = ftrl_rows.state_of(prior.state if prior else None, keys, len(labels), store.spark)
    # a small batch is one task's work in a pass, whose sums then need no exchange
    few = rows.coalesce(1) if size <= FEW_TEXTS else rows
    kept = ftrl_rows.positions(few, keys, idf).persist() if terms else few
    try:
        score = _score_rows(store, kept, state, prior, batch_id, cfg) if prior and scored else Score()
        passes = 2 * cfg.passes if score.drift else cfg.passes
        trained, _ = ftrl_rows.train(kept, state, labels, cfg, passes)
    finally:
        if terms:
            kept.unpersist()
    first = (prior.first_batch if prior else []) + [batch_id] * (len(labels) - len(known))
    total = (prior.state_rows if prior else 0) + len(keys) - state.known
    return store.commit(batch_id, trained.frame(store.spark), labels, first, cfg, score, prior, total)


def _block_step(
    store: ModelStore, batch: DataFrame, batch_id: int, featurise: Featurise, cfg: FtrlConfig, scored: bool, keep_idf: bool,
    prior: Model | None, labels: list[str], size: int, text_bytes: int,
) -> Model:
    """One batch of ``size`` texts by blocks of texts and parts of its terms."""
    state, known = (prior.state, prior.labels) if prior else (None, [])
    work = ftrl_blocks.Training(featurise.tokens(batch), featurise.buckets, size, text_bytes, state, labels, cfg)
    try:
        if keep_idf:
            store.write("idf", batch_id, work.idf().withColumn("texts", F.lit(size).cast("long")))
        score = _counted(store, work.scored(known), prior, batch_id, cfg) if prior and scored else Score()
        trained = work.train(2 * cfg.passes if score.drift else cfg.passes)
        found, met = work.coordinates()
        first = (prior.first_batch if prior else []) + [batch_id] * (len(labels) - len(known))
        total = (prior.state_rows if prior else 0) + found - met
        return store.commit(batch_id, trained, labels, first, cfg, score, prior, total)
    finally:
        work.close()


def _score_rows(
    store: ModelStore, kept: DataFrame, state: ftrl_rows.State, prior: Model, batch_id: int, cfg: FtrlConfig
) -> Score:
    """Write the predictions of the labels known before."""
    size = len(prior.labels)
    before = ftrl_rows.State(state.keys, state.z[:, :size], state.n[:, :size])
    return _counted(store, ftrl_rows.best_label(kept, before, prior.labels, cfg), prior, batch_id, cfg)


def _counted(store: ModelStore, found: DataFrame, prior: Model, batch_id: int, cfg: FtrlConfig) -> Score:
    """Write predictions; they are counted while they are written."""
    seen = Observation()
    labelled = F.col("y").isNotNull()
    store.write(
        "predictions", batch_id,
        found.observe(seen, F.count_if(labelled).alias("rows"), F.count_if(labelled & (F.col("y") == F.col("pred"))).alias("correct")),
    )
    counts = seen.get
    now = counts["correct"] / counts["rows"] if counts["rows"] else None
    drifted = None not in (prior.score.accuracy, now) and prior.score.accuracy - now > cfg.drift_drop
    return Score(counts["rows"], counts["correct"], now, drifted)


def _score(
    store: ModelStore, feats: DataFrame, prior: Model, batch_id: int, cfg: FtrlConfig
) -> Score:
    margin = ftrl.margins(feats, prior.state, prior.state_rows, prior.labels, cfg)
    scored = store.write("predictions", batch_id, ftrl.best_label(margin, prior.labels))
    found = metrics.accuracy(scored).first()
    before = prior.score.accuracy
    now = found["accuracy"]
    drifted = None not in (before, now) and before - now > cfg.drift_drop
    return Score(found["rows"], found["correct"] or 0, now, drifted)


def run(
    store: ModelStore,
    batches: Iterable[tuple[int, DataFrame]],
    featurise: Featurise,
    cfg: FtrlConfig = FtrlConfig(),
) -> ModelStore:
    """P3 over batches in order. Each depends on the model before it, so they run in turn."""
    for batch_id, batch in batches:
        step(store, batch, batch_id, featurise, cfg)
    return store


def with_batch(df: DataFrame, batches: int, order: str = "id") -> DataFrame:
    """Cut a table into ``batches`` equal ranges of a numeric arrival column.

    The bounds come from the file statistics or one small aggregate; every row gets a batch.
    """
    bounds = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    width = F.lit(bounds["high"] - bounds["low"] + 1)
    position = (F.col(order) - F.lit(bounds["low"])) * F.lit(batches)
    return df.withColumn("batch", F.floor(position / width).cast("int"))


def split_batches(
    df: DataFrame, batches: int, order: str = "id"
) -> Iterable[tuple[int, DataFrame]]:
    """The same ranges one by one, each as a filter that reaches the scan."""
    bounds = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, width = bounds["low"], bounds["high"] - bounds["low"] + 1
    for batch_id in range(batches):
        start, end = (low + -(-b * width // batches) for b in (batch_id, batch_id + 1))
        yield batch_id, df.where((F.col(order) >= start) & (F.col(order) < end))


def given_batches(df: DataFrame, batches: int) -> Iterable[tuple[int, DataFrame]]:
    """The batches of a table that has a ``batch`` column, in order."""
    for batch_id in range(batches):
        yield batch_id, df.where(F.col("batch") == batch_id).drop("batch")


def topics(store: ModelStore) -> DataFrame:
    """E4-E6 for all scored batches."""
    return metrics.topics(store.read("predictions"))


