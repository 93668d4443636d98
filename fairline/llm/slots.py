"""Sharding by fixed virtual slots.

A record's slot is a hash modulo a fixed number of slots, so it never changes.
Only the map from slots to shards does: it is a small versioned table, edited
when shards are rebalanced or added.  Editing looks at the bytes per slot and
moves or swaps single slots between the fullest and the emptiest shard until
sizes are near equal.  The map has as many entries as there are slots (a
parameter), however many records there are, so it is held as a literal and no
join is needed to apply it.

DataFrame functions only.  Null texts count as empty, null ids are hashed like a
value, repeated rows share a slot, empty tables give no rows and an even map.
Other columns are not read.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.llm.common import constant_array, text_or_empty
from fairline.session import cut_lineage

#: virtual slots, and what a row weighs beside its text
SLOTS, ROW_BYTES = 8192, 16


@dataclass
class SlotMap:
    """Shard of every virtual slot; ``version`` counts the edits."""

    shards: list[int]
    n_shards: int
    version: int = 0
    moves: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def even(cls, n_shards: int, slots: int = SLOTS) -> "SlotMap":
        return cls([s % n_shards for s in range(slots)], n_shards)

    def column(self, slot: Column) -> Column:
        return F.element_at(constant_array(self.shards), (slot + 1).cast("int")).cast("int")

    def rebalanced(self, weights: list[int], n_shards: int | None = None, tolerance: float = 0.001) -> "SlotMap":
        """The next version: few slots moved so that shards weigh nearly the same.

        Stops when fullest and emptiest differ by at most ``tolerance`` of the
        mean, or when no move or swap brings these two closer.
        """
        n = n_shards or self.n_shards
        shards, load = list(self.shards), [0] * n
        inside: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for slot, shard in enumerate(shards):
            load[shard] += weights[slot]
            inside[shard].append((weights[slot], slot))
        for x in inside:
            x.sort()
        allowed, moves = tolerance * sum(load) / n, []

        def move(item, a, b):
            inside[a].remove(item)
            bisect.insort(inside[b], item)
            load[a] -= item[0]
            load[b] += item[0]
            shards[item[1]] = b
            moves.append((item[1], a, b))

        while True:
            hi, lo = max(range(n), key=load.__getitem__), min(range(n), key=load.__getitem__)
            gap = load[hi] - load[lo]
            best, todo = gap, None
            light = [(0, -1), *inside[lo]]
            for item in inside[hi]:  # the partner whose swap leaves the smallest gap
                at = bisect.bisect(light, (item[0] - gap / 2, -1))
                for other in light[max(0, at - 1) : at + 1]:
                    if item[0] > other[0] and (left := abs(gap - 2 * (item[0] - other[0]))) < best:
                        best, todo = left, (item, other)
            if gap <= allowed or todo is None:
                return SlotMap(shards, n, self.version + 1, moves)
            move(todo[0], hi, lo)
            if todo[1][1] >= 0:
                move(todo[1], lo, hi)

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, slot, shard: the map as a table."""
        ids = spark.range(len(self.shards))
        return ids.select(F.lit(self.version).alias("version"), F.col("id").alias("slot"), self.column(F.col("id")).alias("shard"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table at ``path``; a version that is there is written again alike."""
        self.frame(spark).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> "SlotMap":
        """A version of the table at ``path``, the newest by default.  At most one row per slot comes back."""
        rows = spark.read.parquet(path)
        version = rows.agg(F.max("version")).first()[0] if version is None else version
        shards = [r[0] for r in rows.filter(F.col("version") == version).orderBy("slot").select("shard").collect()]
        return cls(shards, max(shards) + 1, version)


def slot_of(slots: int = SLOTS) -> Column:
    """Virtual slot of a row, by id and text, so that rows without an id spread as well."""
    return F.pmod(F.xxhash64("doc_id", text_or_empty()), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Stored table of doc_id, size, text_crc32 and virtual_slot, which is all that sharding needs."""
    return cut_lineage(docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        slot_of(slots).alias("virtual_slot"),
    ), "slots")


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: at most ``slots`` rows reach the driver."""
    size, count = [0] * slots, [0] * slots
    for slot, b, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[slot], count[slot] = b, n
    return size, count


def sharded(rows: DataFrame, placed: SlotMap, counts: list[int]) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, the row's place in its shard, gapless from 0.

    A slot's rows stand together in the shard, so a place is the slot's offset
    plus the row's number inside the slot; only narrow rows are shuffled, by
    slot.
    """
    offsets, filled = [0] * len(counts), [0] * placed.n_shards
    for slot, shard in enumerate(placed.shards):
        offsets[slot] = filled[shard]
        filled[shard] += counts[slot]
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    at = F.element_at(constant_array(offsets), F.col("virtual_slot") + 1) + F.row_number().over(w) - 1
    return rows.select("doc_id", "size", "text_crc32", placed.column(F.col("virtual_slot")).cast("int").alias("shard"), at.cast("long").alias("slot"), "virtual_slot")
