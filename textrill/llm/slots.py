"""Sharding by fixed virtual slots (operator 4).

Records are hashed by id into a fixed number of slots, the bytes of each slot are added up, and a
versioned map tells the shard of each slot. Rebalancing edits the map: it moves whole slots,
and writes the edited map as the next version. A record's slot never changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import fresh, numbered, table, utf8_size
from textrill.session import materialise, scratch_path

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: decided by the key alone."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot belongs to: ``shards[slot]``."""

    version: int
    count: int
    shards: tuple[int, ...]

    @staticmethod
    def first(slots: int, count: int) -> SlotMap:
        """Version 0: the slots dealt out in turn."""
        return SlotMap(0, count, tuple(s % count for s in range(slots)))

    def rebalanced(self, size: dict[int, int], count: int | None = None) -> SlotMap:
        """The next version, for ``size`` bytes per slot and perhaps more shards.

        Again and again the fullest shard gives the emptiest the slot nearest to half of the
        difference, as long as that makes the larger of the two smaller. The sum of squares falls with
        every move, so it ends; then no slot of the fullest shard is smaller than the
        difference. Slots without bytes stay. The work is bounded by the number of slots.
        """
        count = count or self.count
        shards = list(self.shards)
        load = [0] * count
        held: list[set[int]] = [set() for _ in range(count)]
        for slot, shard in enumerate(shards):
            load[shard] += size.get(slot, 0)
            if size.get(slot, 0):
                held[shard].add(slot)
        while True:
            full, empty = max(range(count), key=load.__getitem__), min(range(count), key=load.__getitem__)
            gap = load[full] - load[empty]
            fit = [s for s in held[full] if size[s] < gap]
            if not fit:
                return SlotMap(self.version + 1, count, tuple(shards))
            slot = min(fit, key=lambda s: (abs(2 * size[s] - gap), s))
            shards[slot] = empty
            held[full].remove(slot)
            held[empty].add(slot)
            load[full] -= size[slot]
            load[empty] += size[slot]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(_slot, _shard)``: as many rows as slots, whatever the data."""
        rows = list(enumerate(self.shards))
        return spark.createDataFrame(rows, "_slot int, _shard int").coalesce(1)

    def save(self, spark: SparkSession, path: str) -> None:
        out = self.frame(spark).select(F.lit(self.count).alias("count"), "_slot", "_shard")
        out.write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("_slot").collect()
        return SlotMap(version, rows[0]["count"], tuple(r["_shard"] for r in rows))


def slot_bytes(sized: DataFrame, slot: str, size: str) -> dict[int, int]:
    """Bytes per slot; at most as many rows as slots reach the driver."""
    return {r[0]: r[1] for r in sized.groupBy(slot).agg(F.sum(size)).collect()}


def assign(docs: DataFrame, shards: int, *, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put documents into shards of near equal bytes.

    Returns the narrow table ``(doc_id, size, text_crc32, virtual_slot, map_version, shard,
    slot)``. ``size`` is the UTF-8 bytes of the text and 8 more; ``slot`` is the place within the
    shard by (doc_id, checksum), gapless from 0. Null text counts as empty, with checksum 0; all
    rows without an id share a slot; rows repeated whole get a place each; an empty table
    gives no rows. The shards' bytes differ by less than the smallest slot of the fullest. Texts
    aren't shuffled: a group of equal texts, or a source, is spread by its ids.
    """
    spark = docs.sparkSession
    sized = materialise(
        docs.select(
            "doc_id",
            (utf8_size(F.col("text")) + 8).alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
            slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
        ),
        "sized",
    )
    path = map_path or scratch_path(spark, "slot-map")
    start = SlotMap.first(slots, shards)
    start.save(spark, path)
    used = start.rebalanced(slot_bytes(sized, "virtual_slot", "size"))
    used.save(spark, path)
    placed = sized.join(
        F.broadcast(used.frame(spark)), F.col("virtual_slot") == F.col("_slot")
    ).select(*sized.columns, F.lit(used.version).alias("map_version"), F.col("_shard").alias("shard"))
    return numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot")


def write_shards(docs: DataFrame, used: SlotMap, path: str) -> None:
    """Write whole rows into a folder per shard, by the slot map."""
    shard, slot = fresh(docs, "shard"), fresh(docs, "_slot_of_row")
    spark = docs.sparkSession
    rows = docs.withColumn(slot, slot_of(F.col("doc_id"), len(used.shards)))
    rows = rows.join(F.broadcast(used.frame(spark)), F.col(slot) == F.col("_slot"))
    rows = rows.select(*(rows[c] for c in docs.columns), F.col("_shard").alias(shard))
    rows.repartition(shard, F.pmod(F.xxhash64("doc_id", F.lit("file")), F.lit(16))).write.partitionBy(shard).parquet(path)


def op4_fixed_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, law ``bytes``."""
    return assign(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
