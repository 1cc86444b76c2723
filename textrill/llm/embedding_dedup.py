"""Near-duplicate embeddings (operator 1).

Random hyperplanes give each vector a sign per plane; the signs of one table make its bucket there. Two vectors at the
threshold share a bucket of ``bits`` signs with probability p = (1 - angle / pi) ** bits, so
``tables`` = ln(miss) / ln(1 - p) tables miss a link at the threshold with at most the chosen
probability, and closer ones much less. ``bits`` grows with the logarithm of the rows, which
keeps the buckets of unlike vectors at ``BUCKET`` rows. Equal vectors are one class with a count.
Pairs within a bucket are compared block by block in tasks, exactly and in double precision. Only sums per
vector and one edge per vector and group leave a task, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import blocks, components, table
from textrill.llm.vectors import component_type, matrix, packed, unpacked, usable
from textrill.session import materialise

THRESHOLD = 0.9
MISS = 1e-5
BUCKET = 512
BLOCK = 2048
SEED = 71


def table_plan(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits per table and tables for a number of classes."""
    bits = min(24, max(4, math.ceil(math.log2(max(1, rows) / BUCKET))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-p))


def planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((count, dim))


def buckets_of(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table, int32."""
    signs = vectors @ planes(vectors.shape[1], bits * tables).T > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int32))


def unit(rows: np.ndarray) -> np.ndarray:
    """Scaled to length 1; by the largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """``(id, key, vec)`` of the usable vectors: a digest of the components, and the components."""
    id_type, kind = vectors.schema["id"].dataType.simpleString(), component_type(vectors)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in np.unique(lengths := np.array([len(x) for x in batch.column(1)])):
                part = batch.filter(pa.array(lengths == group))
                vecs = packed(matrix(part.column(1)) + 0.0, kind)  # minus zero becomes zero
                keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array(vecs)], ["id", "key", "vec"])

    return vectors.where(usable(F.col("vec"))).mapInArrow(code, f"id {id_type}, key binary, vec binary")


def _compare(threshold: float, kind: str):
    """Group function: the links first met in this table, per class, and an edge to its like."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys, part = group["key"].to_pylist(), group["part"].to_numpy()
        at, lo, hi = group["t"][0].as_py(), group["lo"][0].as_py(), group["hi"][0].as_py()
        vecs = unit(unpacked(group["vec"].combine_chunks(), kind))
        sigs, copies = unpacked(group["sig"].combine_chunks(), "<i4"), group["copies"].to_numpy()
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
        short = vecs.astype(np.float32)
        a, b = np.nonzero(short[left] @ short[right].T > threshold - 1e-4)
        a, b = left[a], right[b]
        if lo == hi:
            a, b = a[a < b], b[a < b]
        for i in range(0, len(a), 1 << 16):  # the decision: the sum of products, in double precision
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            same = (vecs[x] * vecs[y]).sum(axis=1) >= threshold
            x, y = x[same], y[same]
            new = ~(sigs[x, :at] == sigs[y, :at]).any(axis=1)
            x, y = x[new], y[new]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            while len(x):  # the least row of each local component
                before = root.copy()
                np.minimum.at(root, x, root[y])
                np.minimum.at(root, y, root[x])
                root = root[root]
                if (before == root).all():
                    break
        told = np.flatnonzero(links)
        return pa.table({
            "key": pa.array([keys[i] for i in told], pa.binary()),
            "links": links[told],
            "root": pa.array([keys[root[i]] for i in told], pa.binary()),
        })

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``(id, vec array)`` to ``(id, n_links, component_id, kept)``, a row per row.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and so do vectors of different lengths with each other; a repeated row is a vector of its own, linked
    with its copies. A component is named by its smallest id; rows without an id have no component of
    their own (null) but count as links, and are kept. An empty table gives no rows.
    """
    kind = component_type(vectors)
    coded = materialise(_classes(vectors), "vectors")
    classes = materialise(
        coded.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec")),
        "classes",
    )
    bits, tables = table_plan(classes.count(), threshold, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x.as_py()) for x in batch.column(2)])
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                sigs = buckets_of(unit(unpacked(part.column(2), kind)), bits, tables).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([s.tobytes() for s in sigs]), pa.array(sigs.tolist(), pa.list_(pa.int32()))],
                    ["key", "copies", "vec", "sig", "buckets"],
                )

    signed = materialise(
        classes.select("key", "copies", "vec").mapInArrow(
            sign, "key binary, copies long, vec binary, sig binary, buckets array<int>"
        ),
        "signed",
    )
    members = signed.select(
        "key", F.octet_length("vec").alias("dim"), F.posexplode("buckets").alias("t", "bucket")
    )
    pairs = blocks(members, ["dim", "t", "bucket"], "key", BLOCK)
    found = materialise(
        pairs.join(signed.select("key", "copies", "vec", "sig"), "key")
        .groupBy("dim", "t", "bucket", "lo", "hi")
        .applyInArrow(_compare(threshold, kind), "key binary, links long, root binary"),
        "links",
    )
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    judged = named.join(least, "root").join(sums, "key", "left").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    usables = coded.select("id", "key").join(judged, "key")
    others = vectors.where(~F.coalesce(usable(F.col("vec")), F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    rows = usables.select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return rows.unionAll(others).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op1_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return near_duplicates(rows).withColumnRenamed("id", "vec_id")
