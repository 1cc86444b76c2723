"""Full-batch gradient descent for dense linear models.

Rows are ``(id, targets ARRAY<DOUBLE>, features ARRAY<DOUBLE>)``: a target per model, null
where the row is not part of that model's training set. All models share each pass over the
rows. A weight vector is as long as the feature vector, a few hundred numbers, so the small
weight matrix lives with the caller and the rows stay where they are; what is shuffled per
pass is one partial gradient per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrill.config import SgdConfig
from textrill.functions import linear

PARTIAL = "model INT, pos INT, g DOUBLE"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(len(column), width)


def _partial_gradients(weights: np.ndarray, loss: str):
    """A task's sum of gradients; position -1 carries the number of rows per model."""
    models, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, width))
        rows = np.zeros(models)
        for batch in batches:
            x = _matrix(batch.column("features"), width)
            t = _matrix(batch.column("targets"), models)
            part = ~np.isnan(t)
            margin = x @ weights.T
            if loss == "hinge":
                sign = 2 * t - 1
                slope = np.where(sign * margin < 1, -sign, 0.0)
            else:
                with np.errstate(over="ignore"):
                    slope = 1 / (1 + np.exp(-margin)) - t
            total += np.where(part, slope, 0.0).T @ x
            rows += part.sum(axis=0)
        full = np.concatenate([rows[:, None], total], axis=1)
        model, pos = np.indices(full.shape)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(model.ravel(), pa.int32()),
                pa.array(pos.ravel() - 1, pa.int32()),
                pa.array(full.ravel(), pa.float64()),
            ],
            names=["model", "pos", "g"],
        )

    return run


def gradient(rows: DataFrame, weights: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradients (models x width) and rows per model, in one pass over ``rows``."""
    partial = rows.select("targets", "features").mapInArrow(
        _partial_gradients(weights, loss), PARTIAL
    )
    full = np.zeros((weights.shape[0], weights.shape[1] + 1))
    for row in partial.groupBy("model", "pos").agg(F.sum("g").alias("g")).collect():
        full[row["model"], row["pos"] + 1] = row["g"]
    return full[:, 1:], full[:, 0]


def sampled(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """L22. About ``fraction`` of the rows, by a digest of seed and id: the same ones however the rows are dealt out."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")))
    return rows.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < fraction * 2.0**32)


def train(
    rows: DataFrame, weights: np.ndarray, cfg: SgdConfig = SgdConfig()
) -> np.ndarray:
    """L14, L15, L17. Weights after at most ``iterations`` steps of step/sqrt(t).

    L2 shrinkage, and a model stops once a step moves it by less than ``tolerance`` relative
    to its length (counted from the second step on), as the library's own optimiser does.
    ``rows`` should be persisted.
    """
    w = np.array(weights, dtype=float)
    active = np.ones(len(w), dtype=bool)
    for t in range(1, cfg.iterations + 1):
        sample = rows if cfg.batch_fraction >= 1 else sampled(rows, cfg.batch_fraction, cfg.seed + t)
        g, n = gradient(sample, w, cfg.loss)
        rate = cfg.step / np.sqrt(t)
        moved = w * (1 - rate * cfg.reg) - rate * g / np.maximum(n, 1)[:, None]
        moving = active & (n > 0)
        moved = np.where(moving[:, None], moved, w)
        if t > 1:
            change = np.linalg.norm(moved - w, axis=1)
            settled = change < cfg.tolerance * np.maximum(np.linalg.norm(moved, axis=1), 1.0)
            active &= ~(settled & moving)
        w = moved
        if not active.any():
            break
    return w


def width_of(rows: DataFrame) -> int:
    """Length of the feature vectors; rows of another length are an error."""
    size = F.size("features")
    found = rows.agg(F.min(size).alias("low"), F.max(size).alias("high")).first()
    if found["low"] != found["high"]:
        raise ValueError(f"feature vectors of {found['low']} to {found['high']} values")
    return found["high"]


def answers(rows: DataFrame, weights: np.ndarray, decide, fields: str, *keys: str) -> DataFrame:
    """``(*keys, fields)`` of ``rows(*keys, features)``: ``decide`` turns the margins of all models, one matrix
    product per Arrow batch, into columns."""
    kept = rows.select(*keys, "features")
    types = [f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = decide(_matrix(batch.column(len(keys)), weights.shape[1]) @ weights.T)
                names = [*keys, *(f"f{i}" for i in range(len(columns)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names)

    return kept.mapInArrow(run, ", ".join([*types, fields]))


def margin(features: str, weights: Sequence[float]) -> Column:
    """Product of a feature array with fixed weights, without leaving the row."""
    values = "array(" + ", ".join(linear.number(w) for w in weights) + ")"
    return F.expr(
        f"aggregate(zip_with({features}, {values}, (x, w) -> x * w), 0.0D, (a, b) -> a + b)"
    )


def probability(features: str, weights: Sequence[float]) -> Column:
    """L14, L19. Probability of the positive class."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(features, weights)))


def binary_targets(target: Column) -> Column:
    """Targets of a single model."""
    return F.array(target.cast("double"))
