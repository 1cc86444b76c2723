"""Nearest neighbours by randomly rotated one-bit codes (operator 8).

Index: every vector is turned by one random rotation, and the signs of its components are kept as packed
bits, with two scalars: its length, and the inner product of its direction with the code's. With
them the inner product with a query is estimated from the bits alone; the error of the
estimate has a bound of ``WIDTH`` times its known deviation, which holds but for a probability that falls like
exp(-WIDTH^2 / 2). Search: a
vector whose upper bound is below the lower bound of enough others can't be among the nearest; the
rest are reranked with the original vectors in double precision.

Queries and rows meet in blocks: every block of queries with every block of rows. A task
holds one block of each and gives out the best of its block, so the work
is dealt out evenly whatever the data, and what leaves a task is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrill.llm.common import table
from textrill.llm.vectors import component_type, matrix, packed, unpacked, usable
from textrill.session import materialise

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
STEP = 1024
WIDTH = 3.5
SEED = 29


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated rows, their lengths, and the codes' inner products with the directions."""
    turned = rows @ rotation(rows.shape[1]).T
    length = np.sqrt((turned * turned).sum(axis=1))
    bits = turned > 0
    fit = np.abs(turned).sum(axis=1) / (length * np.sqrt(rows.shape[1]))
    return np.packbits(bits, axis=1), length, fit


def index(vectors: DataFrame) -> DataFrame:
    """``(id, vec array)`` to the index ``(id, dim, vec, bits, length, fit)`` of every usable row."""
    id_type, kind = vectors.schema["id"].dataType.simpleString(), component_type(vectors)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(1)])
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                rows = matrix(part.column(1))
                # scaled by a power of two, so that no square over- or underflows
                scale = np.exp2(np.floor(np.log2(np.abs(rows).max(axis=1, keepdims=True))))
                bits, length, fit = codes(rows / scale)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([int(dim)] * len(rows), pa.int32()), pa.array(packed(rows, kind)),
                        pa.array([b.tobytes() for b in bits]), pa.array(length * scale[:, 0]), pa.array(fit),
                    ],
                    ["id", "dim", "vec", "bits", "length", "fit"],
                )

    return vectors.where(usable(F.col("vec"))).mapInArrow(
        code, f"id {id_type}, dim int, vec binary, bits binary, length double, fit double"
    )


def _search(k: int, kind: str):
    """Cogroup function: the ``k`` best rows of a block for each query of a block."""

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        queries, rows = queries.combine_chunks(), rows.combine_chunks()
        asked, ids = queries["id"].to_numpy(), rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        q, x = unpacked(queries["vec"].combine_chunks(), kind), unpacked(rows["vec"].combine_chunks(), kind)[order]
        dim = q.shape[1]
        bits = unpacked(rows["bits"].combine_chunks(), np.uint8)[order]
        length, fit = rows["length"].to_numpy()[order], rows["fit"].to_numpy()[order]
        q_length = np.sqrt((q * q).sum(axis=1))
        turned = np.empty((len(q), dim + 1), np.float32)
        turned[:, :dim], turned[:, dim] = (q / q_length[:, None]) @ rotation(dim).T, 1.0
        # bits times these scalars give the estimate for a query of length 1; the last column its error
        factor = length / (fit * np.sqrt(dim))
        error = WIDTH * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(1, dim - 1)) * length + 1e-5 * length
        best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        best = np.full((len(q), k), -np.inf)
        for i in range(0, len(ids), STEP):
            part = slice(i, min(i + STEP, len(ids)))
            code = np.empty((part.stop - i, dim + 1), np.float32)
            code[:, :dim] = (np.unpackbits(bits[part], axis=1, count=dim) * 2.0 - 1.0) * factor[part, None]
            code[:, dim] = error[part]
            upper = turned @ code.T
            floor = best[:, -1] / q_length
            if part.stop - i > k and not np.isfinite(floor).all():
                # as many rows are at least as good as the k-th largest lower bound; one may be the query's own
                lower = upper - 2 * error[part].astype(np.float32)
                floor = np.maximum(floor, np.partition(lower, -k - 1, axis=1)[:, -k - 1])
            a, b = np.nonzero(upper >= floor[:, None].astype(np.float32))
            score = np.empty(len(a))
            for j in range(0, len(a), 1 << 14):
                cut = slice(j, j + (1 << 14))
                score[cut] = (q[a[cut]] * x[i + b[cut]]).sum(axis=1)
            good = (score >= best[a, -1]) & (asked[a] != ids[i + b])
            a, b, score = a[good], b[good], score[good]
            a = np.concatenate([np.repeat(np.arange(len(q)), k), a])
            score = np.concatenate([best.ravel(), score])
            found = np.concatenate([best_id.ravel(), ids[i + b]])
            order = np.lexsort((found, -score, a))
            a, score, found = a[order], score[order], found[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < k
            best[a[keep], place[keep]], best_id[a[keep], place[keep]] = score[keep], found[keep]
        a, p = np.nonzero(best > -np.inf)
        return pa.table({"query_id": asked[a], "vec_id": best_id[a, p], "score": best[a, p]})

    return search


def nearest(queries: DataFrame, rows: DataFrame, k: int, kind: str) -> DataFrame:
    """The ``k`` rows of largest inner product for each query, other than the row of its own id.

    Both are index tables with integer ids, ``kind`` the type of their components. Returns ``(query_id, rank, vec_id, score)``, nearest first, ties
    to the smaller id; fewer where there are fewer. Unusable vectors aren't in the index; vectors of
    different lengths don't meet; rows without an id take no part; repeated rows are rows of their own.
    """
    queries, rows = queries.where("id IS NOT NULL"), rows.where("id IS NOT NULL")
    n_rows = max(1, -(-rows.count() // ROWS_PER_BLOCK))
    n_queries = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, salt: F.pmod(F.xxhash64("id", "vec", F.lit(salt)), F.lit(n)).cast("int")
    left = queries.select("id", "dim", "vec", own(n_queries, "q").alias("qb"), every(n_rows).alias("rb"))
    right = rows.select(
        "id", "dim", "vec", "bits", "length", "fit", own(n_rows, "r").alias("rb"), every(n_queries).alias("qb")
    )
    keys = ("dim", "qb", "rb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _search(k, kind), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op8_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = materialise(index(rows), "onebit-index")
    return nearest(found.where("id % 20 = 0"), found, 20, component_type(rows))
