"""What several operators share: fresh column names, distributed numbering, blocks of a bucket,
connected components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrill.session import materialise

# one word: a run of bytes other than the six ASCII blanks
WORD = r"[^\x20\x09-\x0D]+"
# bytes of the rows that a Python worker is handed at once
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have rows handed to Python in batches of about ``BATCH_BYTES``; by default they may hold 64 MB.

    An executor holds each batch several times over, outside its heap and in its worker. This is a setting of the session,
    as a query runs after it was built; a smaller one stays. All rows are handed over as before.
    """
    bound = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Hand memory that a task has freed back to the system: its worker lives on, and counts with its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver drop what finished steps have left: shuffle files go only when it collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_buckets(counts: DataFrame, bucket: str, n: str, share: float = 0.001) -> DataFrame:
    """The buckets of ``counts(bucket, n)`` with more than ``share`` of all rows, and the ``_pieces`` each is dealt out in.

    Shares add up to 1, so there are at most ``1 / share`` of them: they may always be broadcast.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    most = max(1.0, total * share)
    return counts.where(F.col(n) > most).select(bucket, F.ceil(F.col(n) / most).cast("int").alias("_pieces"))


def bucket_join(left: DataFrame, right: DataFrame, bucket: str, hot: DataFrame, node: str, how: str = "inner") -> DataFrame:
    """Join members with a table of one row per bucket; the members of a hot bucket are spread over its pieces."""
    pieces = F.coalesce("_pieces", F.lit(1))
    hot = F.broadcast(hot)
    dealt = left.join(hot, bucket, "left").withColumn("_piece", F.pmod(F.xxhash64(node), pieces).cast("int")).drop("_pieces")
    copies = right.join(hot, bucket, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return dealt.join(copies, [bucket, "_piece"], how).drop("_piece")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[str | Column], into: str) -> DataFrame:
    """Number the rows of each group from 0 in the given order, without a task per group.

    The rows are dealt out by ranges of (group, order) and sorted, so that a group of any
    size spans as many tasks as it needs. What each task holds of each group is counted, and
    the counts before it are added to the places within the task. The sorted rows are
    written once, as the numbering must not change when a task is run again.
    """
    keys = [*(F.col(c).asc_nulls_last() for c in group), *order]
    at = fresh(df, "_at")
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(at, F.monotonically_increasing_id()),
        "numbered",
    )
    names = [f"_g{i}" for i in range(len(group))]
    part = F.shiftright(F.col(at), 33)
    held = placed.groupBy(
        part.alias("_part"), *(F.col(c).alias(n) for c, n in zip(group, names, strict=True))
    ).agg(F.min(at).alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        "_part", *names, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    same = F.col("_part") == part
    for c, n in zip(group, names, strict=True):
        same = same & placed[c].eqNullSafe(F.col(n))
    return placed.join(starts, same, "left").select(
        *(placed[c] for c in df.columns), (placed[at] + F.col("_shift")).alias(into)
    )


def blocks(members: DataFrame, bucket: list[str], node: str, size: int, hot: DataFrame | None = None) -> DataFrame:
    """Cut large buckets into blocks, and make one group of rows per pair of blocks.

    A bucket of n members has ``ceil(n / size)`` blocks; ``part`` is a member's own. Group
    (bucket, lo, hi) holds the members of the blocks lo and hi, so that every pair of members meets in
    exactly one group, no group has much more than ``2 * size`` rows, and a bucket with few
    members is one group. Buckets of one member are left out.
    """
    counts = members.groupBy(*bucket).agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / size).cast("int")
    met = members.join(counts, bucket) if hot is None else bucket_join(members, counts.drop(*bucket[:-1]), bucket[-1], hot, node)
    own = met.withColumn("_parts", parts).withColumn(
        "part", F.pmod(F.xxhash64(node, F.lit("block")), F.col("_parts")).cast("int")
    )
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return other.select(
        *members.columns,
        "part",
        F.least("part", "_other").alias("lo"),
        F.greatest("part", "_other").alias("hi"),
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: ``(node, root)`` for every node of an edge.

    Contraction: in each round every node goes to the neighbour (or itself) of the least
    digest, and the edges between what remains are kept once. The digest changes from round to round,
    so that chains shrink by a constant share as well; the rounds grow with the logarithm
    of the longest path. Each round's steps and edges are written, which cuts the lineage.
    Neighbours are reduced by a minimum that combines before the shuffle: a hub is no task
    of its own. Only the number of remaining edges reaches the driver.
    """
    left = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(),
        "edges",
    )
    steps: list[DataFrame] = []
    while left.limit(1).count():
        mark = F.lit(len(steps))
        ends = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = ends.unionAll(ends.select("a", F.col("a").alias("b")))
        step = ends.groupBy(F.col("a").alias("node")).agg(
            F.min(F.struct(F.xxhash64("b", mark).alias("h"), F.col("b"))).alias("m")
        )
        steps.append(materialise(step.select("node", F.col("m.b").alias("to")), "steps"))
        to_a = steps[-1].select(F.col("node").alias("a"), F.col("to").alias("x"))
        to_b = steps[-1].select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = materialise(
            left.join(to_a, "a").join(to_b, "b").where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        found = found.join(step.withColumnRenamed("node", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return materialise(found, "components")


def extended(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps``, as ``components`` gives them, after more edges ``(a, b)``.

    Only the edges between the roots so far are contracted, so that a few more of them take few rounds.
    """
    to_a = comps.select(F.col("node").alias("a"), F.col("root").alias("x"))
    to_b = comps.select(F.col("node").alias("b"), F.col("root").alias("y"))
    between = edges.join(to_a, "a", "left").join(to_b, "b", "left")
    more = components(between.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    old = comps.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    new = more.join(comps.select("node"), "node", "left_anti")
    return materialise(old.select("node", F.coalesce("to", "root").alias("root")).unionByName(new), "components")
