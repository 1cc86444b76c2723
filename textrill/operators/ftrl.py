"""Online one-vs-rest FTRL-proximal logistic regression over tables.

Features are long: ``(id, y, idx, v)``, at least one row per text, ``idx`` null for a text
without features. State is one row per coordinate, ``(idx, z ARRAY, n ARRAY)``, the arrays
in label order; a coordinate that is not there, or an array too short for a new label, means
zeros. Keeping the labels in an array lets a feature row meet its state once instead of once
per label.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrill.config import FtrlConfig, JoinPolicy
from textrill.functions import linear
from textrill.operators.joins import fits_broadcast, hot_keys, lookup_join, partitions


def by_text(feats: DataFrame, texts: int) -> DataFrame:
    """Spread the feature rows of ``texts`` texts by text, each text's rows together.

    Persisted in this form, the sums per text that every pass needs run without an exchange.
    """
    return feats.repartition(partitions(feats, texts), "id").sortWithinPartitions("id")


def dense_features(rows: DataFrame, column: str = "features") -> DataFrame:
    """Long features of ``rows(id, y, <array column>)``; the position is the index."""
    values = F.posexplode_outer(F.col(column)).alias("idx", "v")
    return rows.select("id", "y", values).withColumn(
        "v", F.coalesce(F.col("v").cast("double"), F.lit(0.0))
    )


def empty_state(spark: SparkSession, index_type: T.DataType) -> DataFrame:
    """L6. The state before any batch."""
    return spark.sql(
        f"SELECT CAST(NULL AS {index_type.simpleString()}) AS idx, "
        "CAST(NULL AS ARRAY<DOUBLE>) AS z, CAST(NULL AS ARRAY<DOUBLE>) AS n WHERE false"
    )


def known_labels(old: Sequence[str], found: Iterable[str | None]) -> list[str]:
    """D5, L9. Known labels, then the batch's new ones in text order (their ``ord``)."""
    return [*old, *sorted({label for label in found if label is not None} - set(old))]


def label_rows(feats: DataFrame) -> dict[str | None, int]:
    """D5. Feature rows per label of a batch: one small aggregate for labels and size."""
    counted = feats.groupBy("y").agg(F.count("*").alias("feature_rows"))
    return {row["y"]: row["feature_rows"] for row in counted.collect()}


def _at(column: str, position: int) -> str:
    return f"coalesce(get({column}, {position}), 0.0D)"


def _or_zero(column: str) -> str:
    return f"coalesce({column}, 0.0D)"


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def _row_bytes(labels: int) -> int:
    return 96 + 24 * labels


def _columns(state: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The state of some labels as plain columns ``z0, n0, z1, ...``, the form of the passes."""
    return state.selectExpr(
        "idx", *(f"{_at(c, p)} AS {c}{k}" for k, p in enumerate(positions) for c in "zn")
    )


def _with_weights(columns: DataFrame, labels: int, cfg: FtrlConfig) -> DataFrame:
    """L1. Weight columns ``w0, w1, ...`` beside the state columns."""
    return columns.selectExpr(
        "*", *(f"{linear.ftrl_weight(f'z{p}', f'n{p}', cfg)} AS w{p}" for p in range(labels))
    )


def is_label(label: str) -> str:
    """D3. 1.0 for rows of ``label``, else 0.0."""
    return f"(CASE WHEN y = {linear.text(label)} THEN 1.0D ELSE 0.0D END)"


def _gradients(
    feats: DataFrame,
    columns: DataFrame,
    state_rows: int,
    labels: Sequence[str],
    cfg: FtrlConfig,
    hot: DataFrame | None = None,
) -> DataFrame:
    """L2. Feature rows with the state of their coordinate and a gradient ``g{p}`` per label.

    Per text, the margins are sums over its own feature rows; a text was one input row, so
    the window holds no more than that.
    """
    size = range(len(labels))
    joined = lookup_join(
        feats,
        _with_weights(columns, len(labels), cfg),
        "idx",
        right_rows=state_rows,
        row_bytes=_row_bytes(len(labels)),
        spread=F.col("id"),
        policy=cfg.join,
        hot=hot,
    )
    known = [f"{_or_zero(f'{c}{p}')} AS {c}{p}" for p in size for c in "znw"]
    scored = joined.selectExpr("id", "y", "idx", "v", *known).selectExpr(
        "*", *(f"sum(v * w{p}) OVER (PARTITION BY id) AS m{p}" for p in size)
    )
    return scored.where("idx IS NOT NULL").selectExpr(
        "id",
        "idx",
        *(f"{c}{p}" for p in size for c in "znw"),
        *(
            f"({linear.logistic(f'm{p}')} - {is_label(label)}) * v AS g{p}"
            for p, label in enumerate(labels)
        ),
    )


def row_updates(
    feats: DataFrame,
    state: DataFrame,
    state_rows: int,
    labels: Sequence[str],
    cfg: FtrlConfig = FtrlConfig(),
) -> DataFrame:
    """L3. What each feature row adds to each label's state, ``(id, label, idx, dz, dn)``."""
    rows = (
        f"named_struct('label', {linear.text(label)}, "
        f"'dz', {linear.ftrl_delta_z(f'g{p}', f'n{p}', f'w{p}', cfg)}, "
        f"'dn', {linear.ftrl_delta_n(f'g{p}')})"
        for p, label in enumerate(labels)
    )
    columns = _columns(state, range(len(labels)))
    gradients = _gradients(feats, columns, state_rows, labels, cfg)
    return gradients.selectExpr("id", "idx", f"inline({_array(rows)})")


def _one_pass(
    feats: DataFrame,
    columns: DataFrame,
    state_rows: int,
    labels: Sequence[str],
    cfg: FtrlConfig,
    hot: DataFrame | None,
) -> DataFrame:
    """L3, L4. The state columns of the batch's coordinates after one pass over the batch.

    The updates of a coordinate are summed on the map side first, so what is shuffled does
    not grow with how often a term occurs.
    """
    gradients = _gradients(feats, columns, state_rows, labels, cfg, hot)
    updates = []
    for p in range(len(labels)):
        z, n, w, g = f"z{p}", f"n{p}", f"w{p}", f"g{p}"
        # all rows of a coordinate carry the same state: max picks it
        updates += [
            F.expr(f"max({z}) + sum({linear.ftrl_delta_z(g, n, w, cfg)}) AS {z}"),
            F.expr(f"max({n}) + sum({linear.ftrl_delta_n(g)}) AS {n}"),
        ]
    return gradients.groupBy("idx").agg(*updates)


def touched_rows(feats: DataFrame, feature_rows: int, labels: int, cfg: FtrlConfig) -> int:
    """Size of the state a batch touches: exact where its bound alone would forbid a broadcast."""
    if fits_broadcast(feature_rows, _row_bytes(min(labels, cfg.label_chunk)), cfg.join):
        return feature_rows
    return feats.select("idx").distinct().count()


def train(
    feats: DataFrame,
    state: DataFrame,
    state_rows: int,
    labels: Sequence[str],
    cfg: FtrlConfig = FtrlConfig(),
    passes: int | None = None,
    feature_rows: int | None = None,
) -> DataFrame:
    """L5, L7-L9. The whole state after training every label on one batch.

    ``feats`` should be persisted in the form of ``by_text``: each pass reads it once. The
    passes form one plan in which each state is used once, so nothing is written between
    them. Labels are independent of each other and are handled in groups, which keeps rows
    narrow enough for generated code. Rows without a label teach nothing.
    """
    feats = feats.where("y IS NOT NULL")
    passes = cfg.passes if passes is None else passes
    feature_rows = feats.count() if feature_rows is None else feature_rows
    touched = touched_rows(feats, feature_rows, len(labels), cfg)
    groups = [
        range(start, min(start + cfg.label_chunk, len(labels)))
        for start in range(0, len(labels), cfg.label_chunk)
    ]
    widest = _row_bytes(min(len(labels), cfg.label_chunk))
    shuffled = not fits_broadcast(max(touched, state_rows), widest, cfg.join)
    hot = hot_keys(feats, "idx", cfg.join) if shuffled else None
    trained = []
    for group in groups:
        part, rows = _columns(state, group), state_rows
        for _ in range(passes):
            part = _one_pass(feats, part, rows, [labels[p] for p in group], cfg, hot)
            rows = touched
        z, n = (_array(f"{c}{k}" for k in range(len(group))) for c in "zn")
        trained.append(part.selectExpr("idx", f"{z} AS z", f"{n} AS n"))
    batch = reduce(_side_by_side, trained)
    old = state.select("idx", F.col("z").alias("_z"), F.col("n").alias("_n"))
    merged = batch.join(old, "idx", "full_outer")
    return merged.select(
        "idx",
        F.coalesce("z", "_z").alias("z"),
        F.coalesce("n", "_n").alias("n"),
    )


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.select("idx", F.col("z").alias("_z"), F.col("n").alias("_n"))
    return left.join(right, "idx").select(
        "idx", F.concat("z", "_z").alias("z"), F.concat("n", "_n").alias("n")
    )


def margins(
    feats: DataFrame,
    state: DataFrame,
    state_rows: int,
    labels: Sequence[str],
    cfg: FtrlConfig = FtrlConfig(),
) -> DataFrame:
    """Margins of all labels per text, ``(id, y, margin ARRAY)``."""
    size = range(len(labels))
    columns = _with_weights(_columns(state, size), len(labels), cfg)
    table = columns.select("idx", *(f"w{p}" for p in size))
    return linear_margins(feats, table, state_rows, len(labels), cfg.join)


def linear_margins(
    feats: DataFrame, table: DataFrame, table_rows: int, models: int, policy: JoinPolicy
) -> DataFrame:
    """Weighted sums per text, ``(id, y, margin ARRAY)``, of a table ``(idx, w0, w1, ...)``."""
    joined = lookup_join(
        feats,
        table,
        "idx",
        right_rows=table_rows,
        row_bytes=_row_bytes(models),
        spread=F.col("id"),
        policy=policy,
    )
    summed = joined.groupBy("id", "y").agg(
        *(F.expr(f"sum(v * {_or_zero(f'w{p}')}) AS m{p}") for p in range(models))
    )
    return summed.selectExpr("id", "y", f"{_array(f'm{p}' for p in range(models))} AS margin")


def best_label(margin: DataFrame, labels: Sequence[str]) -> DataFrame:
    """L10. ``(id, y, pred, prob)``: the label of highest margin, the earliest on ties.

    Ranking uses the margin: probabilities near 1 are equal in double precision.
    """
    names = _array(map(linear.text, labels))
    return margin.selectExpr(
        "id",
        "y",
        f"get({names}, CAST(array_position(margin, array_max(margin)) AS INT) - 1) AS pred",
        f"{linear.logistic('array_max(margin)')} AS prob",
    )


def label_probabilities(margin: DataFrame, labels: Sequence[str]) -> DataFrame:
    """L11. ``(id, label, prob)``: shares of the label probabilities; (p, 1-p) for two."""
    chance = [linear.logistic(f"get(margin, {p})") for p in range(len(labels))]
    if len(labels) == 2:
        shares = [chance[0], f"1.0D - {chance[0]}"]
    else:
        total = " + ".join(chance)
        shares = [f"try_divide({p}, {total})" for p in chance]
    pairs = (
        f"named_struct('label', {linear.text(label)}, 'prob', {share})"
        for label, share in zip(labels, shares)
    )
    return margin.selectExpr("id", f"inline({_array(pairs)})")


def batch_loss(margin: DataFrame, labels: Sequence[str]) -> DataFrame:
    """L2, L4. Mean loss of each label's model over a batch, ``(label, rows, loss)``."""
    pairs = (
        f"named_struct('label', {linear.text(label)}, "
        f"'loss', {linear.log_loss(f'get(margin, {p})', is_label(label))})"
        for p, label in enumerate(labels)
    )
    return (
        margin.selectExpr(f"inline({_array(pairs)})")
        .groupBy("label")
        .agg(F.count("*").alias("rows"), F.avg("loss").alias("loss"))
    )


def state_by_label(
    state: DataFrame, labels: Sequence[str], cfg: FtrlConfig = FtrlConfig()
) -> DataFrame:
    """The state as one row per label and coordinate, ``(label, idx, z, n, w)``."""
    rows = (
        f"named_struct('label', {linear.text(label)}, 'z', {_at('z', p)}, 'n', {_at('n', p)})"
        for p, label in enumerate(labels)
    )
    long = state.selectExpr("idx", f"inline({_array(rows)})")
    return long.selectExpr("label", "idx", "z", "n", f"{linear.ftrl_weight('z', 'n', cfg)} AS w")
