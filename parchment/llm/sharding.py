"""Sharding by a permutation-filled lookup table, with DataFrame functions only on the rows.

Every shard has its own permutation of the slots of a prime-sized table. Shards take turns; at its turn a shard claims
the first slot of its permutation that is still free. The table is a constant of the plan, so that a row is placed by
one hash and one array access, and a shard that joins or leaves moves little beside its own share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:02d}" for k in range(64))


def _order(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard. slots must be a prime above the number of shards."""
    if len(shards) >= slots or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, and one at least")
    table = [-1] * slots
    at = [_order(name, slots) for name in shards]
    free = slots
    while free:
        for k, (slot, step) in enumerate(at):
            while table[slot] >= 0:
                slot = (slot + step) % slots
            table[slot] = k
            at[k] = (slot + step) % slots, step
            free -= 1
            if not free:
                break
    return table


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    """A hash of the keys as text, nulls as empty, to a slot; the same in any engine that has md5."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % slots


def place(rows: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with `slot` and `shard` (its number in shards) by the values of keys.

    Equal keys share a shard; give a hot key further columns to spread its rows. A null key counts as empty text.
    Columns named slot or shard are replaced. No row moves: the table, of a fixed size, travels with the plan.
    """
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",").cast("array<int>")
    out = rows.withColumn("slot", slot_of([F.col(k) for k in keys], slots))
    return out.withColumn("shard", F.get(table, F.col("slot").cast("int")))
