"""Reads over a view of (key, value): ranges, points, batches of keys and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_bytes, key_lit


def in_range(start: bytes | str = b"", end: bytes | str = b"") -> Column:
    """start <= key < end in byte order; an empty end is no bound. Both are pushed to the scan."""
    found = F.col("key") >= key_lit(start)
    return found & (F.col("key") < key_lit(end)) if as_bytes(end) else found


def scan(view: DataFrame, start: bytes | str = b"", end: bytes | str = b"", ordered: bool = True) -> DataFrame:
    """The pairs of a half-open range in key order; a start at or past the end is an empty range."""
    found = view.where(in_range(start, end))
    return found.orderBy("key") if ordered else found


def successor(prefix: bytes | str) -> bytes:
    """The least key above all keys with ``prefix``, empty if there is none."""
    body = as_bytes(prefix).rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else b""


def prefix_scan(view: DataFrame, prefix: bytes | str) -> DataFrame:
    return scan(view, prefix, successor(prefix))


def get(view: DataFrame, key: bytes | str) -> DataFrame:
    """No row or one."""
    return view.where(F.col("key") == key_lit(key))


def multi_get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, found) for every row of ``keys``. found tells a missing key from an empty value.

    Spark broadcasts the smaller side by its measured size, or sorts and merges both.
    """
    there = view.select("key", "value", F.lit(True).alias("_found"))
    return keys.join(there, "key", "left").select(*keys.columns, "value", F.coalesce("_found", F.lit(False)).alias("found"))


def missing(view: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(view.select("key"), "key", "left_anti")


def count(view: DataFrame) -> DataFrame:
    """One row, n_live; values are not read."""
    return view.agg(F.count(F.lit(1)).alias("n_live"))
