"""Placement of keys on shards through a permutation-filled table; DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.names import col, columns, free

# A prime; the largest table that is broadcast has MAX_SLOTS rows.
SLOTS = 65_537
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot.

    Every shard has its own order of all slots, ``(offset + k * skip) mod slots``; the shards take turns,
    each claiming the first slot in its order that is still free. The table has a fixed size of ``slots``
    entries whatever the data, and losing a shard moves few of the other shards' slots.
    """
    names = list(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("Shards need distinct names, at least one")
    if slots < len(names) or slots > MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("The number of slots must be a prime, at least the number of shards and at most MAX_SLOTS")
    at = [_number("offset:" + n) % slots for n in names]
    skip = [_number("skip:" + n) % (slots - 1) + 1 for n in names]
    owner = [-1] * slots
    left = slots
    while True:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot (0 to ``slots - 1``) and the shard of each row's ``key``.

    The slot is the first 60 bits of the MD5 of the key's text, modulo ``slots``; a null key counts as the
    empty text, so all rows with null or empty keys share a shard. Equal keys always share a shard.
    Columns of ``df`` named as the two new ones are replaced. Rows are neither moved nor aggregated: the
    table, of ``slots`` rows at most MAX_SLOTS, is broadcast.
    """
    spark = df.sparkSession
    names = list(shards)
    owners = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")
    slot, owner_slot, owner = free(df, "key_slot", "table_slot", "table_shard")
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    shard = F.element_at(F.array(*map(F.lit, names)), F.col("owner").cast("int") + 1)
    table = table.select(F.col("slot").cast("long").alias(owner_slot), shard.alias(owner))
    text = F.coalesce(col(key).cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    out = df.select("*", F.pmod(number, F.lit(slots)).alias(slot)).join(F.broadcast(table), F.col(slot) == F.col(owner_slot))
    return out.select(*columns(df, (slot_col, shard_col)), F.col(slot).alias(slot_col), F.col(owner).alias(shard_col))
