"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots; the bytes of each slot are summed; a versioned
map gives each slot its shard, so that shard sizes in bytes are near equal. When shards are
added or sizes drift, the map is edited, not rebuilt: only slots that must move do.

A null text has no bytes; a null doc_id is a key like any other; rows that repeat share a slot.
Positions in a shard are gapless from 0, by slot, then doc_id (null last); ties of doc_id go by
checksum and size. A very long text counts with all its bytes, and can't be split. Other columns of
the input, whatever their names, play no part. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TMP, materialize, text_or_empty

N_SLOTS = 8192
N_SHARDS = 40
#: Bytes that a record needs besides its text.
OVERHEAD = 16
#: Rows that are numbered together in one task; slots with more are cut by a second hash.
ROWS_A_TASK = 50_000


@dataclass(frozen=True)
class SlotMap:
    """Slot-to-shard map; shards[slot] is the slot's shard. Edits give a new version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def balanced(cls, slot_bytes: list[int], n_shards: int) -> SlotMap:
        """A first map: the largest slot goes to the lightest shard. Ties go by number."""
        load = [(0, s) for s in range(n_shards)]
        shards = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
            size, shard = heapq.heappop(load)
            shards[slot] = shard
            heapq.heappush(load, (size + slot_bytes[slot], shard))
        return cls(1, n_shards, tuple(shards))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += slot_bytes[slot]
        return out

    def rebalanced(self, slot_bytes: list[int], n_shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """The next version, with n_shards shards (at least as many as now): slots leave shards
        above the mean for the lightest one, each move lowering the larger of the two, until
        all are within the tolerance or no move helps. A shard that one large slot fills can't be
        helped, and the mean is then that of the others."""
        n = n_shards or self.n_shards
        if n < self.n_shards:
            raise ValueError("shards can be added, not taken away")
        grown = replace(self, version=self.version + 1, n_shards=n)
        load, shards = grown.loads(slot_bytes), list(self.shards)
        members: list[list[int]] = [[] for _ in range(n)]
        for slot, shard in enumerate(shards):
            if slot_bytes[slot]:
                members[shard].append(slot)
        stuck: set[int] = set()
        while True:
            free = [s for s in range(n) if s not in stuck]
            rich = max(free, key=lambda s: (load[s], -s), default=None)
            if rich is None or load[rich] * len(free) <= sum(load[s] for s in free) * (1 + tolerance):
                break
            poor = min(range(n), key=lambda s: (load[s], s))
            room = (load[rich] - load[poor]) / 2
            fits = [s for s in members[rich] if slot_bytes[s] <= room]
            if not fits:
                stuck.add(rich)
                continue
            slot = max(fits, key=lambda s: (slot_bytes[s], -s))
            members[rich].remove(slot)
            members[poor].append(slot)
            shards[slot] = poor
            load[rich] -= slot_bytes[slot]
            load[poor] += slot_bytes[slot]
            stuck.discard(poor)
        return replace(grown, shards=tuple(shards))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, i, s) for i, s in enumerate(self.shards)], "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the store at path; versions are never overwritten."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the last."""
        rows = spark.read.parquet(path)
        at = version if version is not None else rows.agg(F.max("version")).first()[0]
        got = sorted(rows.where(F.col("version") == at).collect(), key=lambda r: r.virtual_slot)
        return cls(at, got[0].n_shards, tuple(r.shard for r in got))


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row, as a stored table."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return materialize(rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int")), "slotted")


def slot_sizes(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; n_slots rows at most reach the driver."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the place in the shard), grown_shard,
    virtual_slot and map_version for each row of docs. store: where the versions of the map are
    kept; with a stored map, its last version is edited to fit the sizes, else a first one is made.
    Rows are placed by what the store gives back."""
    spark = docs.sparkSession
    rows = slotted(docs, id_col, text_col, n_slots)
    sizes, counts = slot_sizes(rows, n_slots)
    held = _stored(spark, store) if store else None
    slots = held.rebalanced(sizes, n_shards) if held else SlotMap.balanced(sizes, n_shards)
    if store:
        slots.save(spark, store)
        slots = SlotMap.load(spark, store)
    cuts = max(1, -(-max(counts, default=0) // ROWS_A_TASK))
    cut = rows.withColumn(f"{TMP}cut", F.pmod(F.xxhash64(F.lit(7), "doc_id", "text_crc32"), F.lit(cuts)).cast("int"))
    placed = cut.join(F.broadcast(slots.frame(spark).select("virtual_slot", "shard")), "virtual_slot")
    part = ["shard", "virtual_slot", f"{TMP}cut"]
    before = Window.partitionBy("shard").orderBy("virtual_slot", f"{TMP}cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*part).agg(F.count("*").alias(f"{TMP}n")).withColumn(f"{TMP}start", F.coalesce(F.sum(f"{TMP}n").over(before), F.lit(0))).drop(f"{TMP}n")
    nth = F.row_number().over(Window.partitionBy(*part).orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size"))
    numbered = placed.withColumn(f"{TMP}nth", nth - 1).join(starts, part)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col(f"{TMP}start") + F.col(f"{TMP}nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"))


def _stored(spark: SparkSession, path: str) -> SlotMap | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return SlotMap.load(spark, path)


def write_shards(docs: DataFrame, path: str, slots: SlotMap, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Whole rows as Parquet under path/to_shard=N, one task to a group of slots."""
    n, text = len(slots.shards), text_or_empty(text_col)
    slot = F.pmod(F.xxhash64(F.col(id_col), F.crc32(text.cast("binary"))), F.lit(n)).cast("int")
    place = slots.frame(docs.sparkSession).select(F.col("virtual_slot").alias(f"{TMP}slot"), F.col("shard").alias("to_shard"))
    keyed = docs.withColumn(f"{TMP}slot", slot).join(F.broadcast(place), f"{TMP}slot")
    keyed.repartition("to_shard", f"{TMP}slot").drop(f"{TMP}slot").write.partitionBy("to_shard").parquet(path)
