"""Sharding by fixed virtual slots.

Records hash into ``n_slots`` virtual slots; bytes are summed per slot; a versioned
slot-to-shard map places slots on shards and is edited, not rebuilt, when the data or
the number of shards changes. The map has ``n_slots`` rows whatever the data holds, so
it is the one thing that is gathered on the driver; it is written as a table, and rows
are placed by what is read back from there. :func:`rebalance` gives the next version.

A row's slot follows from its doc_id and its text's checksum, so rows that share a doc_id
or have none are spread over slots as well; only equal rows share one.

Edge cases: a null text has 0 bytes; a null ``doc_id`` is hashed by its text; repeated
rows are placed one by one; an empty table gives an empty result and an even map;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.store import materialize

N_SLOTS = 4096
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """version, the shard of each slot, and the bytes each slot had when it was edited."""

    version: int
    shards: tuple[int, ...]
    bytes: tuple[int, ...]
    n_shards: int

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for shard, size in zip(self.shards, self.bytes, strict=True):
            out[shard] += size
        return out

    def frame(self, spark: SparkSession, counts: list[int] | None = None) -> DataFrame:
        """Rows (version, virtual_slot, shard, bytes, first), as they are stored; ``first`` counts the shard's rows in earlier slots."""
        seen, rows = [0] * self.n_shards, []
        for i, (shard, size) in enumerate(zip(self.shards, self.bytes, strict=True)):
            rows.append({"virtual_slot": i, "shard": shard, "bytes": size, "first": seen[shard]})
            seen[shard] += counts[i] if counts else 0
        parsed = F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<virtual_slot:bigint,shard:int,bytes:bigint,first:bigint>>"))
        return spark.range(1).select(parsed).select(F.lit(self.version).alias("version"), "virtual_slot", "shard", "bytes", "first")


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, virtual_slot)."""
    text = F.crc32(F.coalesce("text", F.lit("")))
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
        text.alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(n_slots)).alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def plan(slot_bytes: list[int], n_shards: int, version: int = 1) -> SlotMap:
    """Largest slot first onto the lightest shard."""
    shards, heap = [0] * len(slot_bytes), [(0, s) for s in range(n_shards)]
    for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        load, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (load + slot_bytes[slot], shard))
    return SlotMap(version, tuple(shards), tuple(slot_bytes), n_shards)


def rebalance(old: SlotMap, slot_bytes: list[int], n_shards: int | None = None, slack: float = 0.015) -> SlotMap:
    """The next version of a map: shards over the mean by ``slack`` give slots to the lightest one.

    A slot moves only where that lowers the larger of the two loads, so a new shard
    receives slots and the others keep the rest; slots of removed shards move first.
    """
    n = n_shards or old.n_shards
    shards, loads = list(old.shards), [0] * n
    held: list[list[int]] = [[] for _ in range(n)]
    lost = [i for i, s in enumerate(shards) if s >= n]
    for i, s in enumerate(shards):
        if s < n:
            loads[s] += slot_bytes[i]
            held[s].append(i)
    for i in sorted(lost, key=lambda i: (-slot_bytes[i], i)):
        to = min(range(n), key=lambda s: (loads[s], s))
        shards[i] = to
        loads[to] += slot_bytes[i]
        held[to].append(i)
    for _ in range(len(shards)):
        top, low = max(range(n), key=lambda s: (loads[s], -s)), min(range(n), key=lambda s: (loads[s], s))
        mean = sum(slot_bytes) / n
        if loads[top] <= (1 + slack) * mean:
            break
        gap = loads[top] - loads[low]
        fits = [i for i in held[top] if 0 < slot_bytes[i] < gap]
        if not fits:
            break
        room = min(loads[top] - mean, mean - loads[low])
        even = [i for i in fits if slot_bytes[i] <= room]  # neither shard crosses the mean
        best = max(even, key=lambda i: (slot_bytes[i], -i)) if even else min(fits, key=lambda i: (abs(gap - 2 * slot_bytes[i]), i))
        shards[best] = low
        held[top].remove(best)
        held[low].append(best)
        loads[top] -= slot_bytes[best]
        loads[low] += slot_bytes[best]
    return SlotMap(old.version + 1, tuple(shards), tuple(slot_bytes), n)


def assign(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> tuple[DataFrame, SlotMap]:
    """Place every row; also the map that was used.

    The position in its shard (``slot``) counts the rows of earlier virtual slots of the
    same shard and then the rows of its own one by doc_id, so the ordering work is split
    over ``n_slots`` groups instead of ``n_shards``.
    """
    rows = sized(docs, n_slots)
    found = slot_totals(rows).collect()  # n_slots rows at most
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in found:
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["bytes"], r["n"]
    slot_map = plan(sizes, n_shards)
    stored = materialize(slot_map.frame(docs.sparkSession, counts), "slot-map")  # n_slots rows, so fit to be sent to every task
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(F.broadcast(stored), "virtual_slot")
    placed = ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
    return placed, slot_map
