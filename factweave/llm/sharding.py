"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table whose size is a prime: start at an
offset and keep adding a step, both from hashes of the shard's name. The shards take turns; each claims
its first preferred slot that is still free, until the table is full. All shards end within one slot of
each other, and when a shard goes, few slots of the others move. A key's shard is one table lookup.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime; with it the table has about a thousand slots for each of 64 shards.
SLOTS = 65_537
SHARDS = 64


def fill_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """slot -> index of the shard in names. slots must be a prime above the number of names; names differ."""
    if not names or len(set(names)) != len(names) or slots <= len(names):
        raise ValueError("shard names must be distinct, and fewer than the slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    offset = [xxhash.xxh64_intdigest(n, seed=1) % slots for n in names]
    step = [xxhash.xxh64_intdigest(n, seed=2) % (slots - 1) + 1 for n in names]
    owner = np.full(slots, -1, np.int32)
    at, left = list(offset), slots
    while True:
        for shard in range(len(names)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % slots
            owner[slot] = shard
            at[shard] = (slot + step[shard]) % slots
            left -= 1
            if not left:
                return owner


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """A key's slot: its 64-bit hash modulo the slots; a null key hashes like an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """keep (default: the key) with slot and shard for every row, repeated and null keys included.

    The table has exactly `slots` rows of 8 bytes, whatever the data, so its broadcast is bounded; no row
    of df moves. Equal keys share a shard. df's other columns are not read unless kept; columns named
    slot or shard there are replaced by the result's.
    """
    names = names if names is not None else [f"shard-{i:05d}" for i in range(SHARDS)]
    owner = fill_table(names, slots)
    lookup = df.sparkSession.createDataFrame([(s, names[int(o)]) for s, o in enumerate(owner)], "slot int, shard string")
    kept = [c for c in (keep or [key]) if c not in ("slot", "shard")]
    return df.select(*kept, slot_of(key, slots).alias("slot")).join(F.broadcast(lookup), "slot").select(*kept, "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> None:
    """Writes df as one folder for each shard. Rows move once, dealt by (shard, slot), so that no shard is one task."""
    placed = place(df, key, names, slots, keep=df.columns)
    placed.repartition("shard", F.pmod("slot", F.lit(16))).drop("slot").write.partitionBy("shard").parquet(path)
