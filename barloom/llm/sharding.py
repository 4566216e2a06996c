"""Sharding by a lookup table that the shards fill in turns.

Each shard prefers the slots of a prime-sized table in an order of its own, a permutation given by an offset and a
skip. The shards take turns; at its turn a shard claims the first slot of its order that is still free (a shard of
weight w has w turns a round), until the table is full. A key's slot is its hash modulo the size, and the slot's shard
its place: one lookup, whatever the number of shards. When a shard leaves, hardly any keys but its own move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Slots: a prime at least a hundred times the number of shards keeps them within about a percent of each other.
SLOTS = 65_537
SHARDS = 64
#: The table is broadcast; no table may have more slots than this.
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[str]:
    """The shard of every slot. Names must be unique; their order doesn't matter; weights are positive, 1 by default."""
    names = sorted(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards must be named, each once")
    if not _is_prime(slots) or not len(names) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    turns = [(n, max(1, int((weights or {}).get(n, 1)))) for n in names]
    at = {n: _number(f"offset:{n}") % slots for n in names}
    skip = {n: _number(f"skip:{n}") % (slots - 1) + 1 for n in names}
    table: list[str | None] = [None] * slots
    left = slots
    while left:
        for n, times in turns:
            for _ in range(times):
                if not left:
                    break
                slot = at[n]
                while table[slot] is not None:
                    slot = (slot + skip[n]) % slots
                table[slot] = n
                at[n] = (slot + skip[n]) % slots
                left -= 1
    return table  # type: ignore[return-value]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 15 hexadecimal digits of its MD5 as text, modulo the size. A null key is slot 0."""
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return F.coalesce(F.pmod(number, F.lit(slots)), F.lit(0).cast("long")).cast("int")


def sharded(rows: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> DataFrame:
    """``rows`` with slot (int) and shard (string), without a shuffle: the table is broadcast, at most MOST_SLOTS rows.

    Equal keys share a shard; null keys go to the shard of slot 0. Columns of ``rows`` that are named slot or shard are
    replaced. Empty input gives empty output.
    """
    table = lookup_table(shards, slots, weights)
    schema = StructType([StructField("slot", IntegerType(), False), StructField("shard", StringType(), False)])
    lookup = rows.sparkSession.createDataFrame(list(enumerate(table)), schema)
    keep = [c for c in rows.columns if c not in ("slot", "shard")]
    held = rows.select(*(F.col(f"`{c}`") for c in keep), slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return held.join(F.broadcast(lookup), "slot").select(*(F.col(f"`{c}`") for c in keep), "slot", "shard")


def default_shards(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(count)]
