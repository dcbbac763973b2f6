"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots. Bytes are summed per slot, and a small
versioned map says which shard holds each slot. Rebalancing and growing edit the map, never the hash,
so only the records of moved slots move.

Defined cases: a record with a null doc_id is placed by the hash of its text; a null text has no
bytes (size 8, checksum 0); repeated rows are separate records, numbered one after the other; an empty
table gives an empty result and a valid map; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

SLOTS = 4096


@dataclass
class SlotMap:
    """shard_of[slot]; edits make a new version. Its size is the number of slots, whatever the data."""

    shards: int
    shard_of: list[int]
    version: int = 1
    history: list[dict] = field(default_factory=list)

    @classmethod
    def plan(cls, sizes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slot first into the lightest shard; ties by slot and shard number."""
        heap = [(0, k) for k in range(shards)]
        shard_of = [0] * slots
        for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
        return cls(shards, shard_of)

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, size in sizes.items():
            out[self.shard_of[slot]] += size
        return out

    def rebalance(self, sizes: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version: slots leave the heaviest shard for the lightest, each the best fit for half
        the gap, until the spread is within tolerance of the mean or no move narrows it. Slots of removed
        shards go first."""
        shards = shards or self.shards
        shard_of, moved = list(self.shard_of), {}
        load = [0] * shards
        for slot, shard in enumerate(shard_of):
            if shard < shards:
                load[shard] += sizes.get(slot, 0)
        for slot in sorted((s for s, k in enumerate(shard_of) if k >= shards), key=lambda s: -sizes.get(s, 0)):
            to = min(range(shards), key=lambda k: (load[k], k))
            shard_of[slot], moved[slot] = to, to
            load[to] += sizes.get(slot, 0)
        held: list[set[int]] = [set() for _ in range(shards)]
        for slot, shard in enumerate(shard_of):
            if sizes.get(slot, 0):
                held[shard].add(slot)
        mean = sum(load) / shards
        while mean:
            high, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            if gap <= tolerance * mean:
                break
            fits = [s for s in held[high] if sizes[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(sizes[s] - gap / 2), s))
            held[high].remove(slot)
            held[low].add(slot)
            load[high] -= sizes[slot]
            load[low] += sizes[slot]
            shard_of[slot], moved[slot] = low, low
        edit = {"version": self.version + 1, "shards": shards, "moved": len(moved)}
        return SlotMap(shards, shard_of, self.version + 1, [*self.history, edit])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int").coalesce(1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path; a version is written once and never changed."""
        self.frame(spark).write.mode("error").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").select("shards", "virtual_slot", "shard").collect()
        shard_of = [0] * len(rows)
        for r in rows:
            shard_of[r.virtual_slot] = r.shard
        return cls(rows[0].shards, shard_of, version)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id")), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(recs: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows of each slot; as many numbers as there are slots, whatever the data."""
    rows = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: r.b for r in rows}, {r.virtual_slot: r.n for r in rows}


def place(recs: DataFrame, slot_map: SlotMap, rows_of: dict[int, int]) -> DataFrame:
    """Adds shard and the record's place in it: the rows of the slots before its own, then its rank there.

    The rank needs a sort within a virtual slot only, never within a whole shard."""
    spark, at, start = recs.sparkSession, [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        start.append((slot, shard, at[shard]))
        at[shard] += rows_of.get(slot, 0)
    starts = spark.createDataFrame(start, "virtual_slot int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return (
        recs.withColumn("rank", rank)
        .join(F.broadcast(starts), "virtual_slot")  # one row a slot
        .withColumn("slot", F.col("first") + F.col("rank") - 1)
        .withColumn("map_version", F.lit(slot_map.version))
        .drop("first", "rank")
    )


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Plans a map by bytes, stores it as version 1 at path, and places every record by the stored map."""
    spark = docs.sparkSession
    recs = records(docs, slots)
    bytes_of, rows_of = slot_totals(recs)
    path = path or shared_dir(spark, "slot-map")
    SlotMap.plan(bytes_of, shards, slots).save(spark, path)
    return place(recs, SlotMap.load(spark, path, 1), rows_of)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
