"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given
by an offset and a step.  The shards take turns; at its turn a shard claims the
first free slot of its permutation.  A row goes to the shard that holds slot
hash(key) mod table size.  Adding or removing a shard moves few other slots.

The table has a fixed number of rows (its size is the bound of the broadcast);
placing a row is one hash and one look-up, without a shuffle, so no key and no
group of copies makes a task larger.

Defined results: a null key takes the hash of null (all such rows share a slot);
repeated rows share a slot; an empty table gives no rows; other columns of the
input are kept, `slot` and `shard` are replaced if they exist, also where they
are keys (the old values are hashed).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

TABLE_SIZE = 65537
MAX_TABLE_SIZE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(shard: str, salt: str, below: int) -> int:
    digest = hashlib.sha256(f"{salt}\x00{shard}".encode()).digest()
    return int.from_bytes(digest[:8], "big") % below


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The shard index of each slot.  A shard of weight w takes w turns a round."""
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if not _is_prime(size) or size > MAX_TABLE_SIZE or size < len(shards):
        raise ValueError(f"the table size must be a prime of {len(shards)} to {MAX_TABLE_SIZE}")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights: one of 0 or more for each shard, not all 0")
    position = [_draw(s, "offset", size) for s in shards]
    step = [_draw(s, "step", size - 1) + 1 for s in shards]
    owner = [-1] * size
    left = size
    while True:
        for k, turns in enumerate(weights):
            for _ in range(turns):
                p, d = position[k], step[k]
                while owner[p] >= 0:
                    p = (p + d) % size
                owner[p] = k
                position[k] = (p + d) % size
                left -= 1
                if not left:
                    return owner


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """The lookup table as (slot int, shard string), one row for each slot."""
    owner = lookup_table(shards, size, weights)
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "k"))
    return slots.select("slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))


def assign_shards(df: DataFrame, shards: Sequence[str], *keys: str, size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """df with `slot` and `shard`, placed by the values of the key columns."""
    table = table_frame(df.sparkSession, shards, size, weights)
    made = free_name(df, "made")
    placed = df.withColumn(made, F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(size)).cast("int"))
    placed = placed.drop("slot", "shard").withColumnRenamed(made, "slot")
    # size rows at most (MAX_TABLE_SIZE): a bound that the input cannot change
    return placed.join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, shards: Sequence[str], *keys: str, **options) -> None:
    """Write df as one folder a shard.  Tasks write their own part of each shard,
    so that a shard with a third of the rows is still written by all tasks."""
    assign_shards(df, shards, *keys, **options).write.partitionBy("shard").parquet(path)
