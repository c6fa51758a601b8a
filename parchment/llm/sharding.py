"""Shard placement by a permutation-filled lookup table, with DataFrame functions only.

Every shard has its own order of preference over the slots of a table of prime size: offset plus
multiples of a skip. Shards take turns, each claiming the first slot of its order that is still free,
until the table is full. So slots are even to one per shard (times its weight), and when a shard goes, few
slots of the others change. A key's slot is its hash modulo the table size; the table, of fixed size,
is broadcast, and placing a key is one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import unused

# Prime; at 65,537 rows of two integers the broadcast table stays near 1 MB.
SLOTS = 16_381
LARGEST = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: dict[str, int] | list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. ``shards`` are names, or names with whole weights (turns per round).

    Shards take turns in the order of their names, so the table depends on nothing else.
    """
    weight = shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    turns = {s: w for s, w in sorted(weight.items()) if w > 0}
    if not _is_prime(slots) or slots > LARGEST:
        raise ValueError(f"the number of slots must be a prime up to {LARGEST}")
    if not turns or len(turns) > slots:
        raise ValueError("there must be a shard, and a slot for each")
    at, skip = {}, {}
    for s in turns:
        digest = hashlib.sha256(s.encode()).digest()
        at[s] = int.from_bytes(digest[:8], "big") % slots
        skip[s] = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1
    table: list[str | None] = [None] * slots
    free = slots
    while free:
        for s, w in turns.items():
            for _ in range(min(w, free)):
                while table[at[s]] is not None:
                    at[s] = (at[s] + skip[s]) % slots
                table[at[s]] = s
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the first 60 bits of its MD5 as text; a null key counts as the empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(head, 16, 10).cast("bigint") % slots).cast("int")


def lookup(spark: SparkSession, table: list[str]) -> DataFrame:
    """slot and shard, one row per slot."""
    names = sorted(set(table))
    number = {s: k for k, s in enumerate(names)}
    places = F.split(F.lit(",".join(str(number[s]) for s in table)), ",")
    rows = spark.range(1).select(F.posexplode(places).alias("slot", "k"))
    return rows.select("slot", F.array(*[F.lit(s) for s in names])[F.col("k").cast("int")].alias("shard"))


def place(rows: DataFrame, key: str, shards: dict[str, int] | list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``rows`` with the columns ``slot`` and ``shard`` (names may be given). Where ``rows`` has such a column
    already, the new one's name gets underscores until it is free.

    No row moves. Equal keys, null ones included, go to the same shard; a repeated row stays repeated;
    an empty table gives an empty result.
    """
    slot, shard = unused(slot, rows), unused(shard, rows)
    table = lookup(rows.sparkSession, fill_table(shards, slots)).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    with_slot = rows.withColumn(slot, slot_of(rows[key], slots))
    return with_slot.join(F.broadcast(table), slot, "left").select(*rows.columns, slot, shard)


def write(rows: DataFrame, key: str, shards: dict[str, int] | list[str], folder: str, slots: int = SLOTS, rows_per_file: int = 1_000_000) -> None:
    """Parquet files below ``folder``, one subfolder ``shard=...`` each (``shard_=...`` where ``rows`` has a column
    ``shard``, and so on), in files of bounded length.

    Rows are dealt out by shard and slot, and a partition too large for one task is split, so one busy
    shard, or one key with many rows, is written by several tasks.
    """
    slot, shard = unused("_slot", rows), unused("shard", rows)
    placed = place(rows, key, shards, slots, slot, shard).hint("rebalance", shard, slot).drop(slot)
    placed.write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(folder)
