"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard prefers the slots of a prime-sized table in an order of its own. Shards take turns claiming their next free
slot until the table is full, so all get nearly the same number of slots, and a changed shard list moves few slots. A row
is placed by looking up the slot of its key's hash in the broadcast table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the production table, a prime; the broadcast table has as many rows whatever the input is.
SLOTS = 65537
#: A table over this size isn't built: it is broadcast and made on the driver.
MOST_SLOTS = 4_000_037


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of slots: it prefers (offset + j * skip) mod slots for j = 0, 1, ..."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot. Shards must be distinct, and no more than slots."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}, not {slots}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    orders = [preference(s, slots) for s in shards]
    at, table, left = [o for o, _ in orders], [-1] * slots, slots
    while left:
        for k, (_, skip) in enumerate(orders):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + skip) % slots
            table[slot], at[k], left = k, (slot + skip) % slots, left - 1
            if not left:
                break
    return table


def slot_of(key: Column, fallback: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo slots. A null key takes the fallback's hash instead, so null keys don't meet in one slot."""
    digest = F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.coalesce(fallback.cast("string"), F.lit("")))))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: Sequence[str], key_col: str = "doc_id", fallback_col: str = "text", slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """docs with two more columns, slot (int) and shard (string); rows are not moved, dropped or repeated.

    The placement depends on the key, the shards and the slots alone, so it is equal for every run and every split of the
    input. Null keys are placed by the fallback column (null: empty). Texts are not read unless a key is null, however
    long they are. Repeated rows get the same shard. Columns of docs that have the new names are replaced. An empty table
    gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    table = lookup_table(shards, slots)
    # One row per slot: bounded by MOST_SLOTS. Slots stand in a range, shards in two array literals that are folded once.
    numbers = F.split(F.lit(",".join(map(str, table))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(numbers).alias("__residua_slot", "__residua_number")).select("__residua_slot", F.element_at(names, F.col("__residua_number").cast("int") + 1).alias("__residua_shard"))
    kept = [c for c in docs.columns if c not in (slot_name, shard_name)]
    keyed = docs.withColumn("__residua_slot", slot_of(F.col(key_col), F.col(fallback_col) if fallback_col in docs.columns else F.lit(""), slots))
    return keyed.join(F.broadcast(rows), "__residua_slot").select(*[F.col(f"`{c}`") for c in kept], F.col("__residua_slot").alias(slot_name), F.col("__residua_shard").alias(shard_name))


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], **options) -> None:
    """Writes docs as Parquet, one folder for each shard. Tasks have ranges of shards and slots: few shards each, so files are large, and a large shard is in several tasks."""
    placed = place(docs, shards, **options)
    placed.repartitionByRange("shard", "slot").write.partitionBy("shard").parquet(path)
