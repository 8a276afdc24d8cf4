"""Sharding by a permutation-filled lookup table [native].

Every shard walks the slots of a table of prime size in an order of its own; the shards take turns, each
claiming the next slot of its order that is still free, until the table is full.  A key's shard is the
table entry at its hash: one look in a broadcast table of fixed size, no shuffle.  When a shard is added
or goes, few keys move.

Defined cases: a null key counts as the text "\\N"; repeated keys go to one shard; an empty table places
nothing; output names replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards and table size of the registered query; the size is prime and over 100 times the shards.
SHARDS, SLOTS = 64, 6553


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Entry k: which shard owns slot k.  `slots` must be prime, so that every stride visits every slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the table size {slots} is not prime")
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be at least one shard and no more shards than slots")
    at = [_number(f"{s}/offset") % slots for s in shards]
    step = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + step[s]) % slots
        owner[at[s]] = s
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A hash of the key's text, below `slots`; the same in any engine that has md5."""
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Append slot, shard (number) and shard_name to each row."""
    table = F.lit(json.dumps([{"shard": s, "shard_name": shards[s]} for s in lookup_table(shards, slots)]))
    entries = F.from_json(table, "array<struct<shard:int,shard_name:string>>")
    found = df.sparkSession.range(1).select(F.posexplode(entries).alias("slot", "e")).select(F.col("slot").cast("long").alias("slot"), "e.*")
    rows = df.drop(*[c for c in ("slot", "shard", "shard_name") if c != key]).withColumn("slot", slot(F.col(key), slots))
    return rows.join(F.broadcast(found), "slot")  # `slots` rows, whatever the data


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]
