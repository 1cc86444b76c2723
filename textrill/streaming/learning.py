"""Learning on streams (P3, P4, L17-L21, S10): the batch steps called per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textrill.config import FtrlConfig, JoinPolicy, SgdConfig, TextConfig
from textrill.operators import ftrl, sgd, wordvec
from textrill.plans.features import Featurise, tokens_of
from textrill.plans.prequential import step
from textrill.session import path_exists
from textrill.sources import lines
from textrill.sources.model_store import ModelStore

# fixed value: the reading interval of the stream
INTERVAL = "2 seconds"


def each_batch(
    source: DataFrame,
    work: Callable[[DataFrame, int], object],
    checkpoint: str,
    available_now: bool = False,
    interval: str = INTERVAL,
) -> StreamingQuery:
    """S2, S10. Run ``work`` on every micro-batch; progress is kept under ``checkpoint``."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    writer = source.writeStream.foreachBatch(lambda df, batch_id: work(df, batch_id) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def write_batches(
    source: DataFrame, work: Callable[[DataFrame], DataFrame], checkpoint: str, path: str, **options
) -> StreamingQuery:
    """Write what ``work`` makes of micro-batch N to ``path/batch=N``; a replay overwrites it."""

    def write(df: DataFrame, batch_id: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(source, write, checkpoint, **options)


def line_step(
    store: ModelStore,
    named: DataFrame,
    batch_id: int,
    featurise: Featurise,
    cfg: FtrlConfig = FtrlConfig(),
) -> None:
    """P3 on one batch of labelled lines ``(value, file)``.

    Lines that are too short go to the table ``rejects``. The lines with their ids are kept while the batch is worked on, as they
    come out of a shuffle of all lines.
    """
    each = lines.with_ids(named).persist()
    try:
        rows, rejects = lines.parse_labelled(each, keep=["id"])
        store.write("rejects", batch_id, rejects)
        step(store, rows, batch_id, featurise, cfg)
    finally:
        each.unpersist()


def line_stream(
    source: DataFrame,
    store: ModelStore,
    featurise: Featurise,
    checkpoint: str,
    cfg: FtrlConfig = FtrlConfig(),
    available_now: bool = False,
) -> StreamingQuery:
    """P3 on a stream of ``text<TAB>label`` lines, as ``stream_named_lines`` reads them."""

    def work(df: DataFrame, batch_id: int) -> None:
        line_step(store, df, batch_id, featurise, cfg)

    return each_batch(source, work, checkpoint, available_now)


def prequential_stream(
    source: DataFrame,
    store: ModelStore,
    featurise: Featurise,
    checkpoint: str,
    cfg: FtrlConfig = FtrlConfig(),
    available_now: bool = False,
    keep_idf: bool = False,
) -> StreamingQuery:
    """P3 on a stream of the rows the featuriser takes. A replayed batch writes the same."""

    def work(df: DataFrame, batch_id: int) -> None:
        step(store, df, batch_id, featurise, cfg, keep_idf=keep_idf)

    return each_batch(source, work, checkpoint, available_now)


def growing_vectors(
    store: ModelStore,
    base: DataFrame,
    cfg: TextConfig,
    policy: JoinPolicy = JoinPolicy(),
    seed: int = 1,
) -> Featurise:
    """P3's featuriser: update the word vectors from the batch, then embed the batch.

    Each batch writes only the words it adds, so the vectors at a batch are the base and all
    earlier additions, and a word's first vector stays. Before the first model nothing is
    added. A batch whose words have been written before, as ``added_done`` tells, reuses them, so
    that a replay gives the same vectors. ``frozen`` embeds with the vectors before a batch
    and writes nothing.
    """
    split = tokens_of(cfg)
    base_sizes = wordvec.vector_sizes(base, cfg.vector_size)

    def before(batch_id: int) -> DataFrame:
        if not path_exists(store.spark, store.path("added_words")):
            return base
        added = store.read("added_words").where(F.col("batch") < batch_id)
        return base.unionByName(added.select("word", "vec", "origin"))

    def run(batch: DataFrame, batch_id: int) -> DataFrame:
        docs, vectors = split(batch), before(batch_id)
        if store.read_version("added_done", batch_id) is not None:
            vectors = before(batch_id + 1)
        elif store.latest(before=batch_id) is not None:
            new = wordvec.train_new_words(docs, base, cfg.vector_size, seed, policy)
            if new is not None:
                fresh = new.join(vectors.select("word"), "word", "left_anti")
                fresh = store.write("added_words", batch_id, fresh)
                store.write("added_done", batch_id, fresh.sparkSession.range(1))
                vectors = vectors.unionByName(fresh.select("word", "vec", "origin"))
        return embedded(docs, vectors)

    def frozen(batch: DataFrame, batch_id: int) -> DataFrame:
        return embedded(split(batch), before(batch_id))

    def embedded(docs: DataFrame, vectors: DataFrame) -> DataFrame:
        sizes = base_sizes if vectors is base else wordvec.vector_sizes(vectors, cfg.vector_size)
        means = wordvec.document_vectors(docs, vectors, cfg.vector_size, ["y"], policy, sizes)
        return ftrl.dense_features(means)

    run.frozen = frozen
    return run


class StreamingLogistic:
    """L17-L22. Logistic regression that goes on from batch to batch.

    The weights are a versioned table ``(pos, w)``; version -1 holds the initial ones.
    """

    TABLE = "sgd_weights"

    def __init__(self, spark: SparkSession, root: str, cfg: SgdConfig = SgdConfig()):
        self.store = ModelStore(spark, root)
        self.cfg = cfg

    def set_initial_weights(self, weights: list[float]) -> "StreamingLogistic":
        """L22."""
        self._save(-1, np.asarray(weights, dtype=float))
        return self

    def _save(self, version: int, weights: np.ndarray) -> None:
        values = ", ".join(repr(float(w)) + "D" for w in weights)
        table = self.store.spark.range(0, 1, 1, 1).selectExpr(
            f"posexplode(array({values})) AS (pos, w)"
        )
        self.store.write(self.TABLE, version, table)

    def latest_model(self, before: int | None = None) -> list[float]:
        """L21. Weights of the last version, or of the last one before a batch."""
        # the version right before a batch is tried by its path; only a gap makes the store list
        table = None if before is None else self.store.read_version(self.TABLE, before - 1)
        if table is None:
            earlier = [v for v in self.store.versions(self.TABLE) if before is None or v < before]
            if not earlier:
                raise ValueError("the model needs initial weights first")
            table = self.store.read_version(self.TABLE, earlier[-1])
        return [row["w"] for row in table.orderBy("pos").collect()]

    def train_batch(self, rows: DataFrame, batch_id: int) -> None:
        """L17. Train on ``rows(id, y, features)``, y numeric; an empty batch is skipped."""
        prepared = rows.select(
            "id",
            sgd.binary_targets(F.col("y")).alias("targets"),
            F.transform("features", lambda v: v.cast("double")).alias("features"),
        ).persist()
        try:
            if prepared.isEmpty():
                return
            before = np.array([self.latest_model(batch_id)])
            self._save(batch_id, sgd.train(prepared, before, self.cfg)[0])
        finally:
            prepared.unpersist()

    def train_on(
        self, source: DataFrame, checkpoint: str, available_now: bool = False
    ) -> StreamingQuery:
        """L17 on a stream."""
        return each_batch(source, self.train_batch, checkpoint, available_now)

    def predict_on(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """L18-L20. Add ``prob``; all other columns, such as keys, pass through.

        A projection only, so it works on a stream, on a table and on a single row. The weights
        are those of the moment it is called; ``predict_stream`` follows a model in training.
        """
        return rows.withColumn("prob", sgd.probability("features", self.latest_model(before)))

    def predict_stream(
        self, source: DataFrame, checkpoint: str, path: str, **options
    ) -> StreamingQuery:
        """L18, L20 with a live model: each micro-batch is scored with the last weights then."""
        return write_batches(source, self.predict_on, checkpoint, path, **options)
