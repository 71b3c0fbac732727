"""Sharding by a permutation-filled lookup table (the scheme of Maglev hashing, Eisenbud et al., 2016).

Each shard has its own preference order over the slots of a table of prime size: offset, offset + skip, offset + 2 * skip, ... The
shards take turns; each claims the first slot of its order that is still free, until the table is full. Slot counts differ by at
most one, and taking a shard away moves few of the other shards' slots. A row's slot is a hash of its key; the table has a fixed
number of rows whatever the data, and is broadcast.

Defined results: a null key counts as empty text; equal keys meet in one shard; further columns are kept, those named `slot` or
`shard` replaced (the key may have one of these names and is read before); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.shared import shielded

#: A prime, large against the number of shards.
SLOTS = 65_537
SHARDS = 256


def _draw(name: str, what: str, below: int) -> int:
    return int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16) % below


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. The work depends on the number of slots only: about slots * ln(slots) looks."""
    if not shards or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs a shard, and a prime number of slots")
    at = [_draw(s, "offset", slots) for s in shards]
    skip = [_draw(s, "skip", slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for n in range(len(shards)):
            while table[at[n]] >= 0:
                at[n] = (at[n] + skip[n]) % slots
            table[at[n]] = n
            free -= 1
            if not free:
                break
    return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row a slot, read out of one text with a number for each slot."""
    text = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard. One map-side join; no row moves."""
    table = lookup_table(df.sparkSession, shards or shard_names(SHARDS), slots)
    rows, restore = shielded(df, [])
    placed = rows.withColumn("slot", slot_of(F.col(f"__c{df.columns.index(key)}"), slots))
    return restore(placed.join(F.broadcast(table), "slot").select(*rows.columns, "slot", "shard"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """One folder a shard, each with about files_per_shard files; rows of one key may be spread over these."""
    placed = place(df, key, shards, slots)
    n = len(shards or shard_names(SHARDS)) * files_per_shard
    part = F.pmod(F.xxhash64(*(f"`{c}`" for c, t in placed.dtypes if "map<" not in t)), F.lit(files_per_shard))
    placed.repartition(n, "shard", part).drop("slot").write.partitionBy("shard").parquet(path)
