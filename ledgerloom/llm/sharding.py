"""Sharding through a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (offset
plus multiples of a skip, both from a hash of its name). Shards take turns, each
claiming the next slot of its order that is still free, until the table is full: the
shares differ by one slot at most, and removing a shard moves few keys of others.
The table is as large as its prime, whatever the data, so it is broadcast; a row's
place is one hash and one lookup, with no shuffle.

Defined results: a null key has a hash of its own and always the same shard; equal
keys share a shard, repeated rows too; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime number, and no fewer than the shards")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            if not left:
                break
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + skip[k]) % slots
            owner[slot] = k
            at[k] = (slot + skip[k]) % slots
            left -= 1
    return np.array(owner, np.int32)


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    rows = [(s, int(k), shards[k]) for s, k in enumerate(lookup_table(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot, shard and shard_name of its key."""
    taken = {"slot", "shard", "shard_name"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"rename {sorted(taken)} first")
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table(df.sparkSession, shards, slots)), "slot")


def write_sharded(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """Write df as one folder a shard; slots are spread over tasks, so a shard is many files."""
    place(df, key, shards, slots).drop("slot", "shard").repartition("shard_name", F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy("shard_name").parquet(path)


def op5_shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Slot and shard of each document."""
    return place(docs.select("doc_id"), "doc_id", [f"shard-{i:04d}" for i in range(n_shards)]).select("doc_id", "slot", "shard")
