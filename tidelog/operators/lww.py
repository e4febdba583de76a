"""Last-writer-wins views of operations. Pure functions from DataFrame to DataFrame.

The aggregate is associative, commutative and idempotent, so Spark's partial aggregation thins every key
before the shuffle: a key with very many versions sends one row from each task. Filters on the key are pushed
below it to the scan; filters on values stay above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, SET

ORDER = ("seq", "ord")


def latest(ops: DataFrame) -> DataFrame:
    """One row for each key, its last operation, tombstones included: (key, seq, ord, op, value)."""
    newest = F.max_by(F.struct("seq", "ord", "op", "value"), F.struct(*ORDER))
    return ops.groupBy("key").agg(newest.alias("_last")).select("key", "_last.*")


def visible(ops: DataFrame) -> DataFrame:
    """(key, value) of live keys. Tombstones go after the newest is known, never before."""
    return latest(ops).where(F.col("op") == SET).select("key", "value")


def deleted(ops: DataFrame) -> DataFrame:
    """Keys whose last operation is a delete."""
    return latest(ops).where(F.col("op") == DELETE).select("key", "seq")


def as_of(ops: DataFrame, seq: int) -> DataFrame:
    """Operations up to ``seq``; the restriction goes below the aggregate."""
    return ops.where(F.col("seq") <= F.lit(seq))


def batch_last(ops: DataFrame, batch: str) -> DataFrame:
    """The last operation for each (batch, key): what a group commit leaves of repeated keys."""
    newest = F.max_by(F.struct("seq", "ord", "op", "value"), F.struct(*ORDER))
    return ops.groupBy(batch, "key").agg(newest.alias("_last")).select(batch, "key", "_last.*")


def delete_hits(ops: DataFrame) -> DataFrame:
    """Each delete and whether its key was live just before: (key, seq, hit)."""
    from pyspark.sql import Window

    before = F.lag("op").over(Window.partitionBy("key").orderBy(*ORDER))
    return (
        ops.withColumn("_before", before)
        .where(F.col("op") == DELETE)
        .select("key", "seq", F.coalesce(F.col("_before") == SET, F.lit(False)).alias("hit"))
    )
