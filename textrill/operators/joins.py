"""Joining rows with a table that has one row per key.

Every featuriser and learner looks keys up: a term's document frequency, a word's vector,
a coordinate's state. Term keys are skewed (the commonest word is in nearly every text) and
the looked-up tables grow with the vocabulary, so both cases are settled here once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrill.config import JoinPolicy
from textrill.session import shared_dir


# texts per partition below which more partitions cost more than they save
TEXTS_PER_PARTITION = 250
# and above which a partition is split, whatever the session's number
MOST_TEXTS = 100_000


def partitions(df: DataFrame, texts: int) -> int:
    """Partitions to spread a batch of ``texts`` texts over.

    The session's shuffle partitions; fewer for a small batch, whose tasks would otherwise
    do next to nothing, and more for one that would have over ``MOST_TEXTS`` in each.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = max(1, math.ceil(texts / TEXTS_PER_PARTITION))
    return max(min(usual, small), math.ceil(texts / MOST_TEXTS))


def measure(df: DataFrame, key: str, other_bytes: int) -> tuple[int, int]:
    """Rows of a lookup table, and the bytes of one: the mean of its keys as counted, and ``other_bytes`` beside it."""
    size = F.sum(F.octet_length(F.col(key).cast("string")))
    rows, keys = df.agg(F.count("*"), size).first()
    return rows, other_bytes + math.ceil((keys or 0) / max(1, rows))


def fits_broadcast(rows: int, row_bytes: int, policy: JoinPolicy) -> bool:
    """True if a table of ``rows`` rows of ``row_bytes`` bytes may be broadcast."""
    return rows * row_bytes <= policy.broadcast_bytes


def hot_keys(left: DataFrame, key: str, policy: JoinPolicy) -> DataFrame:
    """Keys holding more than ``hot_share`` of the rows, with the pieces each is split into.

    Counting is combined on the map side. Shares add up to 1, so there are at most
    ``1 / hot_share`` such keys, whatever the data: the result may always be broadcast.
    """
    shared_dir(left.sparkSession)
    counts = left.groupBy(key).agg(F.count("*").alias("_rows")).checkpoint()
    total = counts.agg(F.sum("_rows").alias("_total")).first()["_total"] or 0
    piece = max(1.0, total * policy.hot_share)
    return counts.where((F.col("_rows") > piece) & F.col(key).isNotNull()).select(
        F.col(key), F.ceil(F.col("_rows") / piece).cast("int").alias("_pieces")
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    right_rows: int,
    row_bytes: int,
    spread: Column,
    policy: JoinPolicy,
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per ``key``.

    If the counted size of ``right`` is within the policy, it is broadcast and ``left`` is
    not shuffled. Otherwise both are shuffled on the key and a salt: rows of a hot key are
    spread by ``spread`` over as many pieces as it needs, and only those keys are repeated
    in ``right``. Rows without a key are spread as well, as they match nothing. ``hot`` saves
    counting the keys again where the caller joins the same rows several times.
    """
    if fits_broadcast(right_rows, row_bytes, policy):
        return left.join(F.broadcast(right), key, how)

    hot = F.broadcast(hot_keys(left, key, policy) if hot is None else hot)
    no_key_pieces = math.ceil(1 / policy.hot_share)
    pieces = F.when(F.col(key).isNull(), no_key_pieces).otherwise(
        F.coalesce(F.col("_pieces"), F.lit(1))
    )
    salted_left = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), pieces).cast("int"))
        .drop("_pieces")
    )
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return salted_left.join(salted_right.hint("merge"), [key, "_salt"], how).drop("_salt")
