"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

Of the n centred rows X, the components are the right singular vectors and the deviations the singular values over the
root of n. From a start vector v1 the two recurrences

    a_j u_j     = X  v_j - b_(j-1) u_(j-1)
    b_j v_(j+1) = X' u_j - a_j     v_j

give orthonormal u and v with X = U B V' and B upper bidiagonal; its small singular value decomposition is the rest. Both products
of a step are one pass over the rows: every task multiplies its rows with the vector, the result with its rows, and hands on the sum.

The v are short and stay with the caller, reorthogonalised in full and twice. The u have a value per row and are never
stored: each is X times a short vector c_j, so its product with another of them, X b, is (X' u_j) . b, which is at hand, and
full reorthogonalisation changes b alone, before the pass. Where a recurrence ends early, as it does with repeated deviations, it
goes on from a new start vector orthogonal to all before. It takes as many steps as there are dimensions at most, and fewer where the wanted
components have converged before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import table
from textrill.session import materialise

COMPONENTS = 32
STEP, SHIFT = 64, 1_000_000
MOST = 1 << 52  # whole numbers up to here are exact as doubles
SEED = 13
CONVERGED = 1e-14
NOTHING = 1e-12
OUT_ROWS = 2048


def entries(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers ``floor(64 c) + 1000000`` of all entries, where each list's begin and end, which lists to keep."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    finite = np.isfinite(values)
    odd = np.concatenate([[0], np.cumsum(~finite)])
    kept = lists.is_valid().to_numpy(zero_copy_only=False) & (odd[offsets[1:]] == odd[offsets[:-1]]) & (np.diff(offsets) > 0)
    whole = np.clip(np.floor(np.where(finite, values, 0.0) * STEP), -MOST, MOST).astype(np.int64) + SHIFT
    return whole, offsets, kept


def quantised(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, d, x)``: the usable vectors as long integers in a binary, with their length."""
    key_type = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets, kept = entries(batch.column(1))
            places = pa.py_buffer((offsets * 8).astype("<i4"))
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, places, pa.py_buffer(whole.astype("<i8"))])
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), pa.array(np.diff(offsets)[kept], pa.int32()), packed.filter(mask)], ["key", "d", "x"]
            )

    return vectors.select(key, column).mapInArrow(run, f"key {key_type}, d int, x binary")


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _summed(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(matrix of rows)``: one partial sum per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_rows(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    found = rows.select("x").mapInArrow(run, "i int, v double")
    return np.array([r["v"] for r in found.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension, of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _rows(batch.column(0), d)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
            total = [t + (h << 26) + w for t, h, w in zip(total, high, low, strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))], ["i", "v"]
        )

    found = rows.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
    n, *sums = (int(r["v"]) for r in found.orderBy("i").collect())
    return n, sums


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: rows, exact sums, components as columns with their variances, and the sum of all variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean: the whole part of the mean is taken off exactly, then the rest."""
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n x - S)^2``; null where that is no long."""
        if self.n * float(np.abs(x).max(initial=0)) < 2.0**62 and max(map(abs, self.sums)) < 1 << 62:
            off = x * np.int64(self.n) - np.array(self.sums, np.int64)
            if (off.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
                return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def bidiagonalise(
    product: Callable[[np.ndarray], tuple[float, np.ndarray]], d: int, wanted: int, scale: float
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of X, largest first, ``wanted`` at most.

    ``product(b)`` gives |X b|^2 and X' X b in one pass; ``scale`` is the Frobenius norm of X. Values
    that can't be told from 0 are left out.
    """
    rng = np.random.default_rng(SEED)
    tiny = NOTHING * scale
    right, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, c with u = X c, X' u
    alphas: list[float] = []
    betas: list[float] = []

    def start() -> np.ndarray:
        while True:
            v = rng.standard_normal(d)
            for _ in range(2):
                v = v - right @ (right.T @ v)
            if np.linalg.norm(v) > 1e-8:
                return v / np.linalg.norm(v)

    v = start()
    while True:
        right = np.column_stack([right, v])
        b = v.copy()
        for _ in range(2):
            b = b - short @ (back.T @ b)
        square, q = product(b)
        alpha = float(np.sqrt(max(square, 0.0)))
        live = alpha > tiny
        alphas.append(alpha if live else 0.0)
        c, w = (b / alpha, q / alpha) if live else (np.zeros(d), np.zeros(d))
        short, back = np.column_stack([short, c]), np.column_stack([back, w])
        r = w - alphas[-1] * v
        for _ in range(2):
            r = r - right @ (right.T @ r)
        beta = float(np.linalg.norm(r)) if live else 0.0
        k = len(alphas)
        inner = np.diag(alphas) + np.diag(betas, 1)
        left, values, turned = np.linalg.svd(inner)
        rest = (beta * np.abs(left[-1, : min(wanted, k)])).max()
        # a recurrence that ended is no sign that all large values were met, so it is started anew
        if k == d or k >= wanted and beta > tiny and rest <= CONVERGED * values[0]:
            found = min(wanted, int((values > tiny).sum()))
            vectors = right @ turned[:found].T
            return vectors, values[:found]
        betas.append(beta if beta > tiny else 0.0)
        v = r / beta if beta > tiny else start()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows(x)`` of one length; None without rows or where all are equal.

    One pass for the sums, one for the variances, one per step, all over the written rows. To the caller come one number
    per dimension and pass.
    """
    first = rows.select("d").first()
    if first is None:
        return None
    d = first["d"]
    n, sums = _exact_sums(rows, d)
    sums = tuple(sums)
    squares = _summed(rows, d, lambda x: (centred(x, n, sums) ** 2).sum(axis=0))
    total = float(squares.sum())
    if total == 0.0:
        return None

    def product(b: np.ndarray) -> tuple[float, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            p = y @ b
            return np.append(p @ y, p @ p)

        found = _summed(rows, d, of)
        return float(found[-1]), found[:-1]

    vectors, values = bidiagonalise(product, d, min(components, d), float(np.sqrt(total)))
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors, values**2 / n, total / n)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of all whitened rows less the identity."""
    d, k = len(model.sums), len(model.variances)
    mean = _summed(rows, d, lambda x: model.whitened(x).sum(axis=0)) / model.n
    upper = np.triu_indices(k)

    def of(x: np.ndarray) -> np.ndarray:
        y = model.whitened(x) - mean
        return (y.T @ y)[upper]

    off = _summed(rows, d, of) / model.n - (upper[0] == upper[1])
    return float(np.abs(off).max(initial=0.0))


def whiten(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """One row per row and component: ``(key, component, n, deviation, whitened, explained, identity_error)``."""
    d, k = len(model.sums), len(model.variances)
    explained = model.variances / model.trace
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(begin, OUT_ROWS)
                m = part.num_rows
                x = _rows(part.column(1), d)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("key", "x").mapInArrow(
        run, f"key {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def whiten_table(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Quantise, fit and whiten all vectors of ``column``; other columns aren't read.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those of another length than most
    have (of equally many, the longer). Null and repeated keys stay, equal rows stay; an empty table, or one whose rows are all
    equal, has no component and gives no row. Components with no variance are left out. Entries beyond 2^52 count as that; a
    deviation that is no long is null.
    """
    packed = materialise(quantised(vectors, key, column), "quantised")
    usual = packed.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = packed.where(F.col("d") == (usual["d"] if usual else 0))
    model = fit(rows, components)
    if model is None:
        empty = Whitening(1, (0,), np.zeros((1, 0)), np.zeros(0), 1.0)
        return whiten(rows.limit(0), empty, 0.0).withColumnRenamed("key", key)
    return whiten(rows, model, identity_error(rows, model)).withColumnRenamed("key", key)


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened embeddings, a row per vector and component."""
    return whiten_table(table(spark, sf_dir, "embeddings"))
