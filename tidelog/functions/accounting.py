"""Byte accounting of operations, write amplification, and percentiles without interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SET

#: Bytes of a log record beside its key and value: length, checksum, type and two lengths.
RECORD = 17
#: Bytes of bookkeeping for an entry held in memory.
ENTRY = 8


def value_bytes() -> Column:
    return F.coalesce(F.octet_length("value"), F.lit(0))


def logical_bytes() -> Column:
    """What a caller wrote: key and value of a set, the key of a delete."""
    return (F.octet_length("key") + F.when(F.col("op") == SET, value_bytes()).otherwise(0)).cast("long")


def log_bytes() -> Column:
    return (F.lit(RECORD) + F.octet_length("key") + value_bytes()).cast("long")


def entry_bytes() -> Column:
    return (F.octet_length("key") + value_bytes() + F.lit(ENTRY)).cast("long")


def spent() -> list[Column]:
    """Aggregates over operations: their number, logical and log bytes."""
    return [
        F.count(F.lit(1)).alias("n_ops"),
        F.coalesce(F.sum(logical_bytes()), F.lit(0)).alias("logical_bytes"),
        F.coalesce(F.sum(log_bytes()), F.lit(0)).alias("log_bytes"),
    ]


def written(ops: DataFrame) -> DataFrame:
    """One row of spent()."""
    return ops.agg(*spent())


def amplification(logical: Column, log: Column, flush: Column, compact: Column) -> Column:
    """Bytes written for each logical byte; zero before the first write."""
    return F.when(logical == 0, F.lit(0.0)).otherwise((log + flush + compact).cast("double") / logical.cast("double"))


#: Stretches of values that a column is cut into to find its percentiles.
STRETCHES = 128


def percentile_below(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """The value at floor(share * (n - 1)) in sorted order, for each share, without interpolation.

    Values are first counted. Without groups, approximate quantiles cut them into stretches, whose totals are few rows;
    only the stretches with a wanted place are then ranked, each in a task of its own. With ``by``, a group's
    distinct values meet in one task.
    """
    from pyspark.sql import Window

    keys = by or []
    there = df.where(F.col(column).isNotNull())
    names = [f"p{round(p * 100)}" for p in shares]
    counted = there.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        ranked = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy(column)))
        joined = ranked.join(counted.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
        picks = [
            F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_total") - 1)), F.col(column))).alias(name)
            for p, name in zip(shares, names)
        ]
        return joined.groupBy(*keys).agg(*picks)
    cuts = there.agg(F.percentile_approx(column, [i / STRETCHES for i in range(1, STRETCHES)], 10 * STRETCHES).alias("c")).first()["c"] or []
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array(F.lit(0.0))
    stretch = F.size(F.filter(bounds, lambda c: c < F.col(column)))
    placed = counted.withColumn("_s", stretch)
    sums = {r["_s"]: r["n"] for r in placed.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}  # STRETCHES rows
    wanted = {name: int(p * (sum(sums.values()) - 1)) for p, name in zip(shares, names)} if sums else {}
    before, at = 0, {}
    for s, n in sorted(sums.items()):
        for name, place in wanted.items():
            if before <= place < before + n:
                at[name] = (s, place - before)
        before += n
    ranked = placed.where(F.col("_s").isin(sorted({s for s, _ in at.values()}))).withColumn(
        "_upto", F.sum("_n").over(Window.partitionBy("_s").orderBy(column))
    )
    nowhere = F.lit(None).cast(df.schema[column].dataType)
    return ranked.agg(*(
        F.min(F.when((F.col("_s") == at[n][0]) & (F.col("_upto") > at[n][1]), F.col(column)) if n in at else nowhere).alias(n) for n in names
    ))
