"""Evaluation of predictions (E1-E9): accuracy, weighted scores, topics, drift, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (truth, prediction); the only pass over the scored rows that E1 needs."""
    return scored.groupBy(*by, "y", "pred").agg(F.count("*").alias("rows"))


def weighted_scores(scored: DataFrame) -> DataFrame:
    """E1. One row: accuracy, and precision, recall and F1 weighted by the true label's share."""
    cells = confusion(scored)
    hit = F.when(F.col("y") == F.col("pred"), F.col("rows")).otherwise(0)
    # a cell counts once for its true label and once for its predicted label
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("y").alias("label"),
                    F.col("rows").alias("true_rows"),
                    F.lit(0).cast("long").alias("pred_rows"),
                    hit.cast("long").alias("hits"),
                ),
                F.struct(
                    F.col("pred").alias("label"),
                    F.lit(0).cast("long").alias("true_rows"),
                    F.col("rows").alias("pred_rows"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        )
    )
    per_label = sides.groupBy("label").agg(
        F.sum("true_rows").alias("t"), F.sum("pred_rows").alias("p"), F.sum("hits").alias("h")
    )
    scores = per_label.select(
        "t",
        "h",
        F.coalesce(F.try_divide("h", "p"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("h", "t"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.lit(2.0) * F.col("h"), F.col("t") + F.col("p")), F.lit(0.0)).alias(
            "f1"
        ),
    )

    def weighted(score: str) -> F.Column:
        return F.try_divide(F.sum(F.col(score) * F.col("t")), F.sum("t"))

    return scores.agg(
        F.sum("t").alias("rows"),
        F.try_divide(F.sum("h"), F.sum("t")).alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )


def label_counts(scored: DataFrame) -> DataFrame:
    """E2. Rows per label, as truth and as prediction."""
    both = scored.select(
        F.inline(
            F.array(
                F.struct(F.lit("truth").alias("kind"), F.col("y").alias("label")),
                F.struct(F.lit("prediction").alias("kind"), F.col("pred").alias("label")),
            )
        )
    )
    return both.groupBy("kind", "label").agg(F.count("*").alias("rows"))


def accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E3, E9. Labelled rows, correct rows and their share."""
    correct = F.when(F.col("y") == F.col("pred"), 1).otherwise(0)
    counted = scored.where(F.col("y").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(correct).cast("long").alias("correct")
    )
    return counted.withColumn("accuracy", F.try_divide("correct", "rows"))


def topics(scored: DataFrame, by: Sequence[str] = ("batch",)) -> DataFrame:
    """E4-E6. Per batch and predicted label: rows, highest probability, strength.

    Strength is the highest probability times the label's share of the batch. The share
    comes from a window over the few topic rows, not over the texts.
    """
    counted = scored.groupBy(*by, F.col("pred").alias("topic")).agg(
        F.count("*").alias("rows"), F.max("prob").alias("max_prob")
    )
    total = F.sum("rows").over(Window.partitionBy(*by))
    return counted.withColumn("strength", F.col("max_prob") * (F.col("rows") / total))


def drift(batch_accuracy: DataFrame, drop: float = 0.2) -> DataFrame:
    """E7. Flag batches whose accuracy fell by more than ``drop`` since the one before.

    The input has one row per batch, so the global order is over batches, not texts.
    """
    last = F.lag("accuracy").over(Window.partitionBy(F.lit(0)).orderBy("batch"))
    return batch_accuracy.withColumn(
        "drift", F.coalesce(last - F.col("accuracy") > drop, F.lit(False))
    )


def majority(votes: DataFrame) -> DataFrame:
    """E8. ``(id, y, pred)``: the commonest ``vote`` of each row, the lowest one on ties.

    Votes are counted per (row, vote) first, so the pick compares at most one entry per
    label.
    """
    counted = votes.groupBy("id", "y", "vote").agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("order"), F.col("vote").alias("pred")))
    return counted.groupBy("id", "y").agg(best.alias("best")).select("id", "y", "best.pred")
