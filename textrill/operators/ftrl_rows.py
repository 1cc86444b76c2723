"""FTRL over rows that hold a text each, for batches whose coordinates fit the caller.

A batch touches a limited set of coordinates: the terms in it, or the places of its vectors. While their state, two numbers per
label, stays within the broadcast bound, it lives with the caller and goes to the tasks, as a broadcast of it would. Rows stay where
they are: every pass reads the kept rows once, works out margins and updates of whole Arrow batches with arrays, and
shuffles one partial sum of (dz, dn, loss) per task and coordinate, summed by Spark. Nothing is exploded, joined or windowed.
Larger batches go by ``ftrl.train``, which keeps the state distributed; both give the same sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.config import FtrlConfig

# index and value arrays of a row, with the id and label of its text
Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


def term_rows(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """F1 in row form: ``(id, y, idx ARRAY, v ARRAY)`` of ``docs(id, y, tokens)``, the counts of each row's own terms."""
    tokens, kind = F.col("tokens"), "string"
    if buckets is not None:
        tokens, kind = F.transform("tokens", lambda t: F.pmod(F.hash(t), F.lit(buckets))), "int"
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts, ends = [], [], [0]
            for tokens in batch.column(2).to_pylist():
                found = Counter(t for t in tokens or () if t is not None)
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string() if kind == "string" else pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.float64())),
                ],
                ["id", "y", "idx", "v"],
            )

    return docs.select("id", "y", tokens.alias("tokens")).mapInArrow(
        run, f"id {id_type}, y string, idx array<{kind}>, v array<double>"
    )


def vector_rows(rows: DataFrame) -> DataFrame:
    """``(id, y, v ARRAY<DOUBLE>)`` of rows that are vectors; a null value counts as 0."""
    return rows.select("id", "y", F.col("features").cast("array<double>").alias("v"))


@dataclass
class State:
    """L6. The coordinates of a batch in order, with z and n as matrices (coordinate x label)."""

    keys: pa.Array
    z: np.ndarray
    n: np.ndarray
    known: int = 0

    def weights(self, cfg: FtrlConfig) -> np.ndarray:
        """L1."""
        rate = cfg.lambda2 + (cfg.beta + np.sqrt(self.n)) / cfg.alpha
        shrunk = self.z - np.sign(self.z) * cfg.lambda1
        return np.where(np.abs(self.z) <= cfg.lambda1, 0.0, -shrunk / rate)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The table form ``(idx, z ARRAY, n ARRAY)``."""
        ends = np.arange(len(self.keys) + 1, dtype=np.int32) * self.z.shape[1]
        lists = (pa.ListArray.from_arrays(ends, np.ascontiguousarray(m).ravel()) for m in (self.z, self.n))
        return spark.createDataFrame(pa.Table.from_arrays([self.keys, *lists], ["idx", "z", "n"]))


def fits(coordinates: int, key_bytes: int, labels: int, cfg: FtrlConfig) -> bool:
    """True if the state of so many coordinates, of so long names together, may live with the caller and go to every task."""
    return key_bytes + coordinates * (96 + 24 * labels) <= cfg.join.broadcast_bytes


def state_of(state: DataFrame | None, keys: pa.Array, labels: int, spark: SparkSession) -> State:
    """L6, L9. The state of the coordinates ``keys``; zeros for those and for labels that it lacks.

    Only rows of these coordinates leave the state: the keys are broadcast to it.
    """
    z, n = np.zeros((len(keys), labels)), np.zeros((len(keys), labels))
    if state is None or not len(keys):
        return State(keys, z, n)
    wanted = spark.createDataFrame(pa.Table.from_arrays([keys], ["idx"]))
    found = state.join(F.broadcast(wanted), "idx", "left_semi").select("idx", "z", "n").toArrow()
    at = pc.index_in(found["idx"].combine_chunks().cast(keys.type), value_set=keys).to_numpy()
    fill(z, n, at, found)
    return State(keys, z, n, len(at))


def fill(z: np.ndarray, n: np.ndarray, at: np.ndarray, found: pa.Table) -> None:
    """Put the arrays ``z`` and ``n`` of state rows into the rows ``at`` of the matrices."""
    for into, name in ((z, "z"), (n, "n")):
        lists = found[name].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten().to_numpy()
        begins = np.cumsum(sizes) - sizes
        into[np.repeat(at, sizes), np.arange(len(flat)) - np.repeat(begins, sizes)] = flat


def positions(rows: DataFrame, keys: pa.Array, weights: np.ndarray | None = None) -> DataFrame:
    """``(id, y, pos ARRAY<INT>, v ARRAY<DOUBLE>)``: the place of each index among ``keys``, values times its weight."""
    shared = rows.sparkSession.sparkContext.broadcast((keys, weights))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = shared.value
        for batch in batches:
            idx, v = batch.column(2), batch.column(3)
            at = pc.index_in(idx.flatten(), value_set=keys)
            values = v.flatten()
            if weights is not None:
                values = pa.array(values.to_numpy() * weights[at.to_numpy()])
            offsets = pa.array(np.append(0, np.cumsum(pc.list_value_length(idx).to_numpy())), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (at, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "y", "pos", "v"])

    return rows.mapInArrow(run, f"id {id_type}, y string, pos array<int>, v array<double>")


def _arrays(batch: pa.RecordBatch, width: int) -> Arrays:
    """Place, value and row of every entry; of vectors, the place is the position within."""
    values = batch.column(batch.num_columns - 1)
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy()
    v = pc.fill_null(values.flatten(), 0.0).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    if batch.num_columns == 4:
        return batch.column(2).flatten().to_numpy(), v, row
    return np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes), v, row


def _margins(pos: np.ndarray, v: np.ndarray, row: np.ndarray, rows: int, w: np.ndarray) -> np.ndarray:
    if len(v) == rows * len(w) and len(w) and (pos[: len(w)] == np.arange(len(w))).all() and (row == np.repeat(np.arange(rows), len(w))).all():
        return v.reshape(rows, len(w)) @ w
    out = np.empty((rows, w.shape[1]))
    for k in range(w.shape[1]):
        out[:, k] = np.bincount(row, weights=v * w[pos, k], minlength=rows)
    return out


def logistic(margin: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -margin))


def pass_sums(rows: DataFrame, w: np.ndarray, n: np.ndarray, labels: Sequence[str], cfg: FtrlConfig):
    """L2-L4. Sums of dz and dn over all labelled rows, and each label's mean loss, for the state at the start of a pass."""
    spark, size = rows.sparkSession, len(labels)
    shared = spark.sparkContext.broadcast((w, n))
    names = [f"{c}{k}" for k in range(size) for c in ("dz", "dn")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = shared.value
        root = np.sqrt(n)
        dz, dn = np.zeros(w.shape), np.zeros(w.shape)
        loss, count = np.zeros(size), 0
        order = pa.array(labels, pa.string())
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            if not batch.num_rows:
                continue
            truth = pc.index_in(batch.column(1), value_set=order).to_numpy(zero_copy_only=False)
            pos, v, row = _arrays(batch, len(w))
            margin = _margins(pos, v, row, batch.num_rows, w)
            hit = truth[:, None] == np.arange(size)
            loss += np.where(hit, np.logaddexp(0.0, -margin), np.logaddexp(0.0, margin)).sum(axis=0)
            count += batch.num_rows
            off = logistic(margin) - hit
            for k in range(size):
                g = off[row, k] * v
                square = g * g
                change = (np.sqrt(n[pos, k] + square) - root[pos, k]) / cfg.alpha * w[pos, k]
                dz[:, k] += np.bincount(pos, weights=g - change, minlength=len(w))
                dn[:, k] += np.bincount(pos, weights=square, minlength=len(w))
        met = np.flatnonzero((dn != 0).any(axis=1) | (dz != 0).any(axis=1))
        # place -1 carries losses and rows
        columns = [pa.array(np.append(c[met, k], extra)) for k in range(size) for c, extra in ((dz, loss[k]), (dn, count))]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1), pa.int32()), *columns], ["pos", *names])

    partial = rows.mapInArrow(run, ", ".join(["pos INT", *(f"{c} DOUBLE" for c in names)]))
    found = partial.groupBy("pos").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    shared.unpersist()
    at = found["pos"].to_numpy()
    sums = np.stack([found[c].to_numpy() for c in names], axis=1)
    dz, dn, inside = np.zeros(w.shape), np.zeros(w.shape), at >= 0
    dz[at[inside]], dn[at[inside]] = sums[inside, 0::2], sums[inside, 1::2]
    total = sums[~inside].sum(axis=0)
    return dz, dn, total[0::2] / np.maximum(total[1::2], 1.0)


def train(
    rows: DataFrame, state: State, labels: Sequence[str], cfg: FtrlConfig = FtrlConfig(), passes: int | None = None
) -> tuple[State, np.ndarray]:
    """L5, L7-L9. The state of the batch's coordinates after training every label, and the loss of each pass and label.

    ``rows`` are kept rows ``(id, y, pos, v)`` or, of vectors, ``(id, y, v)``. Rows without a label teach nothing. The
    loss of a pass is that of the state it starts from.
    """
    z, n = state.z.copy(), state.n.copy()
    losses = np.zeros((cfg.passes if passes is None else passes, len(labels)))
    for start in range(0, len(labels), cfg.label_chunk):
        group = slice(start, min(start + cfg.label_chunk, len(labels)))
        for k in range(len(losses)):
            w = State(state.keys, z[:, group], n[:, group]).weights(cfg)
            dz, dn, losses[k, group] = pass_sums(rows, w, n[:, group], labels[group], cfg)
            z[:, group] += dz
            n[:, group] += dn
    return State(state.keys, z, n, state.known), losses


def best_label(rows: DataFrame, state: State, labels: Sequence[str], cfg: FtrlConfig) -> DataFrame:
    """L10. ``(id, y, pred, prob)`` of kept rows: the label of highest margin, the earliest on ties."""
    shared = rows.sparkSession.sparkContext.broadcast(state.weights(cfg))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, order = shared.value, pa.array(labels, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            margin = _margins(*_arrays(batch, len(w)), batch.num_rows, w)
            best = margin.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), order.take(pa.array(best)), pa.array(logistic(margin.max(axis=1)))],
                ["id", "y", "pred", "prob"],
            )

    return rows.mapInArrow(run, f"id {id_type}, y string, pred string, prob double")


def losses_frame(spark: SparkSession, labels: Sequence[str], losses: np.ndarray) -> DataFrame:
    """L5. ``(label, pass, loss)``, passes from 1."""
    found = [(label, k + 1, float(losses[k, j])) for j, label in enumerate(labels) for k in range(len(losses))]
    return spark.createDataFrame(found, "label string, pass int, loss double")


def term_statistics(rows: DataFrame) -> DataFrame:
    """F2. ``(idx, df)`` of term rows: in how many each term is."""
    terms = rows.select(F.explode_outer("idx").alias("idx")).where("idx IS NOT NULL")
    return terms.groupBy("idx").agg(F.count("*").alias("df"))
