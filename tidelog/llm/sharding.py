"""Placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, and over 100 for each shard, which bounds how far shards differ in load.
SLOTS = 65537
#: Rows a table may have to be sent to every executor.
MOST_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of a shard for every slot.

    Each shard has its own order of preference over the slots (offset, offset + skip, ...; ``slots`` is
    prime, so this meets every slot). The shards take turns, each claiming the first free slot of its
    order, until all are claimed. Shards with few changes keep most of their slots.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots > MOST_SLOTS or slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at least the number of shards, and at most {MOST_SLOTS}")
    offset = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    at, out, left = list(offset), [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            out[at[i]] = i
            left -= 1
            if not left:
                return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 32 bits of the md5 of its text, modulo the slots. A null key is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns slot int and shard string; existing columns of these names are replaced.

    The table has ``slots`` rows at most (MOST_SLOTS), so it is broadcast; placing a row is one hash and
    one look-up, without a shuffle, and a hot key costs no more than any other. Equal keys share a
    shard, repeated rows stay, an empty table gives an empty result.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(fill(shards, slots))), "_slot int, _shard int")
    names = F.array(*(F.lit(s) for s in shards))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return (
        df.withColumn("_key_slot", slot_of(F.col(key), slots))
        .join(F.broadcast(table), F.col("_key_slot") == F.col("_slot"))
        .select(*kept, F.col("_slot").alias("slot"), F.get(names, F.col("_shard")).alias("shard"))
    )


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write placed rows, a folder for each shard. Rows are spread by shard and a salt of eight, so that a
    shard with many rows is written by several tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != "shard"]), F.lit(8))
    spread = df.repartition(F.col("shard"), salt)
    spread.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
