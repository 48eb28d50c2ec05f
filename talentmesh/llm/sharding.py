"""Sharding: a lookup table that shards fill in turn, each along its own permutation of the slots."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmesh.llm.common import body, shuffle_partitions

#: Slots of the table; a prime, some thousand times the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(48))
#: Largest table that is sent to every task: slots are a parameter, not a property of the data.
MAX_SLOTS = 1_000_003


def fill_slots(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Slot -> position in ``shards``.

    A shard prefers the slots offset, offset + skip, offset + 2 skip, ... modulo the prime
    number of slots, which is a permutation of all of them. Shards take turns and each claims
    the first free slot on its list, so counts differ by one at most, and a shard that comes
    or goes moves few other slots. Shards are named uniquely; their order in the list decides
    only whose turn is first, so they are sorted by name.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots > MAX_SLOTS or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, no smaller than the number of shards")
    place = {name: i for i, name in enumerate(shards)}
    walks = []
    for name in sorted(shards):
        digest = hashlib.md5(name.encode()).digest()
        offset = int.from_bytes(digest[:8], "big") % slots
        skip = int.from_bytes(digest[8:], "big") % (slots - 1) + 1
        walks.append([place[name], offset, skip])
    table, left = [-1] * slots, slots
    while left:
        for walk in walks:
            shard, at, skip = walk
            while table[at] >= 0:
                at = (at + skip) % slots
            table[at] = shard
            walk[1] = (at + skip) % slots
            left -= 1
            if not left:
                break
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    filled = ",".join(shards[i] for i in fill_slots(shards, slots))
    row = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "shard"))
    return row.select(F.col("slot").cast("long").alias("slot"), "shard")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row with its slot and shard.

    Columns ``slot`` and ``shard`` are added in front; input columns of those names give way.
    The slot is the 60-bit head of the key's md5, modulo the number of slots. Rows with equal
    keys, repeated rows included, meet in one shard; a null key counts as the empty string.
    The join is against a table of ``slots`` rows, which is broadcast.
    """
    own = docs.drop("slot", "shard")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))
    table = lookup_table(docs.sparkSession, shards, slots)
    return own.withColumn("slot", slot).join(F.broadcast(table), "slot")


def placements(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard and the text's bytes, one row per row of ``docs``."""
    rows = docs.select("doc_id", F.octet_length(body()).cast("long").alias("n_bytes"))
    return place(rows, "doc_id", shards, slots).select("doc_id", "slot", "shard", "n_bytes")


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 1_000_000, **options: int) -> None:
    """Write ``docs`` below ``path``, a folder per shard, in files of bounded length.

    A hot shard is spread over tasks by slot, and a slot by key, so no task holds a shard whole.
    """
    placed = place(docs, **options)
    parts = shuffle_partitions(docs.sparkSession)
    spread = placed.repartition(parts, "shard", F.pmod(F.xxhash64("slot", "doc_id"), F.lit(parts)))
    spread.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
