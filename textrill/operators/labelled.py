"""Labelled rows and batch shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrill.session import shared_dir

# fixed value: the increasing id holds the partition above these bits, the row below
RANGE_BITS = 33


def attach_labels(docs: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """S5. Labels ``(key, y)`` from a side table; ``unlabelled`` gives the documents without one."""
    return docs.join(labels.select(key, "y"), key)


def unlabelled(docs: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """S5. The rejects of ``attach_labels``: documents whose key is null or has no label."""
    return docs.join(labels.select(key), key, "left_anti")


def with_ordinal(
    df: DataFrame, order: Sequence[str | Column], name: str = "ordinal"
) -> DataFrame:
    """S5, F9. An explicit position from 0, for side files that match only by order.

    The sort spreads rows in ranges; a row's position is its place in its range plus the
    rows of the ranges before. The increasing id holds both, range and place, so beyond the
    sort nothing is shuffled but one count per range.
    """
    shared_dir(df.sparkSession)
    ranged = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    of_range = F.shiftright("_at", RANGE_BITS)
    sizes = ranged.groupBy(of_range.alias("_range")).agg(F.count("*").alias("_rows"))
    # one row per range of the sort
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << RANGE_BITS) - 1))
    return (
        ranged.withColumn("_range", of_range)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + place)
        .drop("_range", "_start", "_at")
    )


def pair_with_labels(vectors: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """D1. Join vectors and labels one to one; unequal counts and unmatched, repeated or null keys are errors."""
    left, right = vectors.count(), labels.count()
    if left != right:
        raise ValueError(f"{left} vectors but {right} labels")
    sides = vectors.select(key, F.lit(1).alias("_left"), F.lit(0).alias("_right")).unionAll(
        labels.select(key, F.lit(0), F.lit(1))
    )
    odd = sides.groupBy(key).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right")).where(
        F.col(key).isNull() | (F.col("_left") != 1) | (F.col("_right") != 1)
    )
    if found := odd.select(key).take(3):
        raise ValueError(f"keys without exactly one vector and one label, such as {[r[0] for r in found]}")
    return vectors.join(labels, key)


def labelled_rows(df: DataFrame, features: str, label: str | None = None) -> DataFrame:
    """D2. ``(id, features, y)``; a row without a label gets "0.0", a number its text."""
    y = F.lit("0.0") if label is None else F.col(label).cast("string")
    values = F.transform(F.col(features), lambda v: v.cast("double"))
    return df.select("id", values.alias("features"), y.alias("y"))


def one_vs_rest(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """D3. One row per (row, label) with ``target`` 1.0 for the row's own label, else 0.0.

    The labels are few and sit in the expression: rows are repeated in place, not joined.
    """
    each = F.explode(F.array(*(F.lit(label) for label in labels)))
    return df.withColumn("label", each).withColumn(
        "target", F.when(F.col("y") == F.col("label"), 1.0).otherwise(0.0)
    )


def batch_size(feats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D4. Rows of a batch and the highest feature position."""
    return feats.groupBy(*by).agg(
        F.count_distinct("id").alias("rows"), F.max("idx").alias("max_index")
    )


def distinct_labels(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D5. Labels that occur in a batch."""
    return df.select(*by, "y").distinct()


def random_parts(
    df: DataFrame, shares: Sequence[float] = (0.7, 0.3), seed: int = 1
) -> list[DataFrame]:
    """D6. Seeded random split."""
    return df.randomSplit(list(shares), seed)


def keyed_part(key: str = "id", share: float = 0.7) -> Column:
    """D6. "train" or "test" by the last digits of the key: the same split on every run.

    As many digits as the share has decimals, up to six; a finer share is an error.
    """
    modulus = next((10**n for n in range(1, 7) if abs(share * 10**n - round(share * 10**n)) < 1e-9), 0)
    if not modulus:
        raise ValueError(f"share {share} has more than six decimals")
    train = F.pmod(F.col(key), F.lit(modulus)) < round(share * modulus)
    return F.when(train, "train").otherwise("test")


def shifted_label(y: Column, by: int) -> Column:
    """D7. A numeric label moved by a constant."""
    return (y.cast("double") + by).cast("int").cast("string")


def binary_label(y: Column, zero: str = "0") -> Column:
    """D7. 0.0 for the label ``zero``, else 1.0."""
    return F.when(y == zero, 0.0).otherwise(1.0)


def centroids(rows: DataFrame) -> DataFrame:
    """X1. Mean vector per label, ``(label, pos, v)``; summed on the map side."""
    values = rows.select(F.col("y").alias("label"), F.posexplode("features").alias("pos", "v"))
    return values.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
