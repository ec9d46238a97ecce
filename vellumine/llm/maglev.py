"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, given by an offset and a stride
from hashes of its name. Shards take turns: each claims the next free slot of its preference order
until the table is full. A row's shard is the table's entry at its key's hash modulo the size. The
table is small and of a known size, so it is broadcast; placement is one hash lookup a row.

The table has `size` rows of two integers (16 bytes), at most MOST_SLOTS, whatever the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest table that may be broadcast: 2**20 rows, 16 MB.
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int, weights: dict[str, int] | None = None) -> np.ndarray:
    """Shard number for each slot. Shards with weight w claim w slots a turn; weight 0 takes no part.

    Raises ValueError for no shards, repeated names, a size that isn't prime, too small or over MOST_SLOTS.
    """
    live = [(i, s, (weights or {}).get(s, 1)) for i, s in enumerate(shards)]
    live = [x for x in live if x[2] > 0]
    if not live or len(set(shards)) != len(shards):
        raise ValueError("shards must have distinct names, and one a weight above 0")
    if not is_prime(size) or not len(live) <= size <= MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime from {len(live)} to {MOST_SLOTS}")
    table = np.full(size, -1, dtype=np.int32)
    at = {i: _number(s, "offset") % size for i, s, _ in live}
    stride = {i: _number(s, "stride") % (size - 1) + 1 for i, s, _ in live}
    left = size
    while left:
        for i, _, weight in live:
            for _ in range(weight):
                slot = at[i]
                while table[slot] >= 0:
                    slot = (slot + stride[i]) % size
                table[slot] = i
                at[i] = (slot + stride[i]) % size
                left -= 1
                if not left:
                    return table
    return table


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5, the same in any engine. A null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def table_frame(spark: SparkSession, shards: list[str], table: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(slot, int(i), shards[i]) for slot, i in enumerate(table.tolist())], "slot long, shard_id int, shard string")


def place(df: DataFrame, key: str, shards: list[str], size: int, weights: dict[str, int] | None = None) -> DataFrame:
    """The rows with `slot` (long), `shard_id` (int) and `shard` (string); columns of these names are replaced.

    Equal keys share a shard; every row is kept, null keys included; an empty table stays empty.
    """
    entries = F.broadcast(table_frame(df.sparkSession, shards, lookup_table(shards, size, weights)))
    return df.drop("slot", "shard_id", "shard").withColumn("slot", F.pmod(key_hash(df[key]), F.lit(size))).join(entries, "slot")
