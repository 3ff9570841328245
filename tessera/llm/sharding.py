"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table, a permutation from two hashes of its name;
shards take turns claiming their next free slot until the table is full. Rows find their slot by a hash of their key and their
shard by the table, which is broadcast: its size is the prime, fixed by a parameter and checked. Shares differ by little, and
when a shard comes or goes most keys stay where they were.

Defined results: a null key is a key like any other (all nulls share a slot unless spread). Rows of one key share a shard;
with ``spread`` over 1, a key's rows go to up to so many shards, for keys that hold too many rows for one: by a hash of
``spread_by``, or by a number that each row is given where no column is named. Equal rows are rows each, in spreading and in
the files of a shard. One row comes out for each row that goes in, with all its columns; those named as the new ones get a ``_`` behind
their names. Texts of any length go along unread. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import runtime

#: The table is broadcast, 8 bytes a slot.
MOST_SLOTS = 2_000_000
OWN = ("slot", "shard_id", "shard")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = 65_537) -> np.ndarray:
    """The index of the shard in each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or not _is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError("shards must be distinct names, fewer than slots, a prime of at most 2,000,000")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    table, free, turn = [-1] * slots, slots, 0
    while free:
        k = turn % len(shards)
        while table[place[k]] >= 0:
            place[k] = (place[k] + skip[k]) % slots
        table[place[k]], free, turn = k, free - 1, turn + 1
    return np.array(table, np.int32)


def slot_of(keys: list[Column], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(df: DataFrame, key_cols: list[str], shards: list[str], slots: int = 65_537, spread: int = 1, spread_by: str | None = None) -> DataFrame:
    """df with slot (int), shard_id (int) and shard (string). Spread without ``spread_by``, df is stored with row numbers first."""
    table = lookup_table(shards, slots)
    if spread > 1 and spread_by is None:
        rows, row = runtime.numbered(df)
        return place(rows, key_cols, shards, slots, spread, row).drop(row)
    keys = [df[c] for c in key_cols]
    if spread > 1:
        keys.append(F.pmod(F.xxhash64(df[spread_by]), F.lit(spread)))
    held = df.sparkSession.createDataFrame(pd.DataFrame({"_s": np.arange(slots, dtype=np.int32), "_k": table, "_name": np.array(shards, object)[table]}), "_s int, _k int, _name string")
    names: list[str] = []
    for c in df.columns:
        while c.lower() in (*OWN, *map(str.lower, names)):
            c += "_"
        names.append(c)
    placed = df.select(*[df[c].alias(n) for c, n in zip(df.columns, names, strict=True)], slot_of(keys, slots).alias("slot"))
    held = held.select(*[F.col(c).alias(f"{c}_{len(names)}_") for c in held.columns])
    slot, shard_id, shard = (F.col(c) for c in held.columns)
    return placed.join(F.broadcast(held), placed["slot"] == slot).select(*names, "slot", shard_id.alias("shard_id"), shard.alias("shard"))


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1, row: str | None = None) -> None:
    """One folder a shard, so many files each. row: a column that tells rows apart, equal ones too, and is the same when a task
    runs again; rows are dealt over a shard's files by it, and it isn't written. Without it, if there are several files,
    the rows are stored with numbers first."""
    if files_per_shard > 1 and row is None:
        placed, row = runtime.numbered(placed)
    file = F.pmod(F.xxhash64(placed[row]), F.lit(files_per_shard)) if row else F.lit(0)
    dealt = placed.withColumn("_file", file).repartition("shard_id", "_file")
    dealt.drop("_file", *([row] if row else [])).write.partitionBy("shard_id").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``write_shards`` wrote, in the columns of schema; shard_id comes from the folders' names."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
