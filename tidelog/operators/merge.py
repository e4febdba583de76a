"""Merges of runs, recovery from a base and a log, and the intact prefix of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SET
from .lww import latest


def merge(runs: list[DataFrame], drop_tombstones: bool) -> DataFrame:
    """The newest version of each key over ``runs``.

    Tombstones may go only if no run outside ``runs`` can hold an older version of a key; see
    plans.compaction.tombstones_may_go. Nothing left is an empty result.
    """
    merged = latest(reduce(DataFrame.unionByName, runs))
    return merged.where(F.col("op") == SET) if drop_tombstones else merged


def recover(base: DataFrame, log: DataFrame) -> DataFrame:
    """Operations of a base state and of a log; they may overlap, as replay is idempotent."""
    return base.unionByName(log)


def valid_prefix(log: DataFrame, intact: Column, order: str = "seq") -> DataFrame:
    """Rows before the first that is not ``intact``. The cut is one minimum, taken with partial aggregation and
    joined as a single row; no window runs over the whole log."""
    cut = log.where(~intact).agg(F.min(order).alias("_cut"))
    return (
        log.join(F.broadcast(cut))  # one row
        .where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut")))
        .drop("_cut")
    )


def dropped_report(log: DataFrame, intact: Column, order: str = "seq") -> DataFrame:
    """One row: where the log is cut (null: nowhere), rows kept and rows dropped."""
    cut = log.where(~intact).agg(F.min(order).alias("cut_at"))
    kept = F.col("cut_at").isNull() | (F.col(order) < F.col("cut_at"))
    return (
        log.join(F.broadcast(cut))
        .groupBy("cut_at")
        .agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped"))
    )
