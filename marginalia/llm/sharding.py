"""Consistent placement by a permutation-filled lookup table; DataFrame functions only on the data.

Each shard has its own order of preference over the slots of a prime-sized table and shards take turns claiming their
best free slot. The table has as many entries whatever the data, is built once by the caller and broadcast; a row finds
its shard by one hash and one lookup. When a shard leaves, its slots are dealt to the others and few other slots move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Slots of the table: a prime, over a hundred a shard.
SLOTS = 8191
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. Shards hold equally many slots, one more or less."""
    if not is_prime(slots) or len(shards) > slots or len(set(shards)) != len(shards) or not shards:
        raise ValueError("the table needs a prime size, and distinct shards, one at least and no more than slots")
    seeds = [int(hashlib.md5(s.encode()).hexdigest(), 16) for s in shards]
    offset = [s % slots for s in seeds]
    skip = [(s >> 64) % (slots - 1) + 1 for s in seeds]
    table, turn, taken = [-1] * slots, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while table[slot := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            table[slot] = i
            taken += 1
            if taken == slots:
                return table


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table. Null keys count as empty strings."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, keys: Sequence[str] = ("doc_id",), shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with slot and shard (its name). No shuffle: the table, of ``slots`` rows, is broadcast.

    Equal keys meet in one shard; keys with a third of the rows need a second key column to spread. A column of
    ``docs`` named slot or shard, in whatever case, is replaced. Empty tables give empty results.
    """
    table = lookup_rows(docs.sparkSession, shards, slots)
    own = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    rows = docs.select(*own, slot_of([F.col(k) for k in keys], slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot", "left").select(*own, "slot", "shard")


def lookup_rows(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard); one literal that Spark unfolds."""
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    numbers = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(numbers).alias("slot", "number")).select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("number").cast("int")).alias("shard"))
