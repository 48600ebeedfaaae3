"""Sharding by fixed virtual slots [native].

Every record is hashed into one of a few thousand slots; the slot count never changes. Bytes and
rows are summed by slot, and a small versioned map, a table in the shared folder, says which shard each
slot belongs to. A new map deals slots out evenly, before any data is known. When slots grow unevenly or
a shard is added, the map is edited: few slots move, the edit is stored as the next version, and no
record is hashed anew. The query stores the first version and edits it by the slots' bytes.

Only DataFrame functions touch records. The driver sees the slot totals and the map alone: ``n_slots``
rows, whatever the corpus holds.

Under the law ``bytes`` a record's size alone decides how shards are balanced: equal texts, of which a
third of the corpus may consist, are dealt over all shards by their ids and not kept together.

Defined results: a null text has no bytes, so its size is ``overhead``; an empty text likewise.
The hash takes id, size and checksum, so equal ids don't meet in one slot; rows without an id are
dealt out by their place in the input, however many there are. Rows that repeat in full, id included, are
separate records of one slot. An empty table gives an empty assignment. Extra columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, shared_root, staged

N_SLOTS = 4096
#: Bytes that a record costs besides its text.
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each slot; every edit makes a new version and keeps what moved."""

    shards: tuple[int, ...]
    n_shards: int
    version: int = 1
    moved: tuple[tuple[int, int, int], ...] = field(default=())

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        """Slots dealt out in turn, as long as nothing is known of them."""
        return cls(tuple(i % n_shards for i in range(n_slots)), n_shards)

    @classmethod
    def balanced(cls, weights: list[int], n_shards: int) -> SlotMap:
        """Heaviest slot first onto the lightest shard; ties by slot and shard number."""
        heap = [(0, s) for s in range(n_shards)]
        owner = [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            load, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (load + weights[slot], shard))
        return cls(tuple(owner), n_shards)

    def rebalanced(self, weights: list[int], n_shards: int, slack: float = 0.001) -> SlotMap:
        """Edit the map for new weights or more shards, moving slots only out of overfull shards.

        The fullest shard gives slots to the lightest while it holds over ``1 + slack`` times the mean: each
        time the slot that comes nearest to what the one has too much of and the other lacks, as long as
        the move lowers the greater of both loads. An edit of an edited map moves nothing. Fewer
        shards than before is an error: a shard must be emptied by hand before it is removed.
        """
        if n_shards < self.n_shards:
            raise ValueError("a map can't lose shards")
        owner = list(self.shards)
        load = [0] * n_shards
        held: list[set[int]] = [set() for _ in range(n_shards)]
        for slot, shard in enumerate(owner):
            load[shard] += weights[slot]
            held[shard].add(slot)
        mean = sum(weights) / n_shards
        moved: dict[int, int] = {}
        stuck: set[int] = set()
        while over := [s for s in range(n_shards) if s not in stuck and load[s] > mean * (1 + slack)]:
            shard = max(over, key=lambda s: (load[s], -s))
            to = min(range(n_shards), key=lambda s: (load[s], s))
            wanted = min(load[shard] - mean, mean - load[to])
            fit = [i for i in held[shard] if weights[i] and load[to] + weights[i] < load[shard]]
            if not fit:
                stuck.add(shard)
                continue
            slot = min(fit, key=lambda i: (abs(weights[i] - wanted), i))
            held[shard].remove(slot)
            held[to].add(slot)
            load[shard] -= weights[slot]
            load[to] += weights[slot]
            owner[slot] = to
            moved.setdefault(slot, shard)
        moves = tuple((i, was, owner[i]) for i, was in sorted(moved.items()) if owner[i] != was)
        return SlotMap(tuple(owner), n_shards, self.version + 1, moves)

    def store(self, spark: SparkSession, folder: str) -> None:
        """Write the map as a table of its version; a version that is there already is an error."""
        self.frame(spark).withColumn("n_shards", F.lit(self.n_shards)).coalesce(1).write.mode("error").parquet(f"{folder}/version-{self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
        """The map of a version, by default the latest; null if none is stored."""
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return None
        found = sorted(x.getPath().getName() for x in fs.listStatus(target) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
        wanted = f"version-{version:06d}" if version else found[-1] if found else None
        if wanted not in found:
            return None
        rows = sorted(spark.read.parquet(f"{folder}/{wanted}").collect(), key=lambda r: r["vslot"])  # n_slots rows
        return cls(tuple(r["shard"] for r in rows), rows[0]["n_shards"], rows[0]["map_version"])

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table of ``n_slots`` rows: vslot, shard, map_version."""
        rows = [(i, s, self.version) for i, s in enumerate(self.shards)]
        return spark.createDataFrame(rows, "vslot int, shard int, map_version int")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every record."""
    text = F.col(text_col)
    records = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "size", "text_crc32"))
    return records.withColumn("vslot", F.pmod(key, F.lit(n_slots)).cast("int"))


def slot_totals(records: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has records; partial sums are made before the shuffle."""
    return records.groupBy("vslot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def shard_records(
    df: DataFrame, n_shards: int = 24, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, overhead: int = OVERHEAD
) -> tuple[DataFrame, SlotMap]:
    """Assign every record to a shard; returns the assignment and the map that made it.

    The map is the latest below ``folder``, a new one if there is none (by default the folder is new),
    edited for the records' bytes; an edit is stored there as the next version.

    The assignment has doc_id, size, text_crc32, vslot, shard, map_version and ``slot``, the
    record's place in its shard (gapless from 0). Places come from two levels, a running count of
    the shard's slots and a row number inside one slot, so no task ever sorts a whole shard.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_root(spark)}/maskwright/slot-map-{uuid.uuid4().hex}"
    slot_map = SlotMap.load(spark, folder)
    if slot_map is None:
        slot_map = SlotMap.initial(n_slots, n_shards)
        slot_map.store(spark, folder)
    n_slots = len(slot_map.shards)
    records = staged(digest(df, id_col, text_col, n_slots, overhead), "shard-digest")  # a row's slot is drawn once
    totals = {r["vslot"]: (r["rows"], r["bytes"]) for r in slot_totals(records).collect()}
    edited = slot_map.rebalanced([totals.get(i, (0, 0))[1] for i in range(n_slots)], n_shards)
    if edited.moved or edited.n_shards != slot_map.n_shards:
        edited.store(spark, folder)
        slot_map = SlotMap.load(spark, folder, edited.version)
    start, first = [0] * slot_map.n_shards, []
    for i, shard in enumerate(slot_map.shards):
        first.append((i, shard, start[shard], slot_map.version))
        start[shard] += totals.get(i, (0, 0))[0]
    places = spark.createDataFrame(first, "vslot int, shard int, first long, map_version int")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    out = (
        records.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(places), "vslot")  # n_slots rows
        .withColumn("slot", F.col("first") + F.col("place"))
        .drop("first", "place")
    )
    return out, slot_map


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards under the law of near equal bytes."""
    out, _ = shard_records(read_table(spark, sf_dir, "documents"), 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"
    )
