"""Schemas of operations, runs and pairs. They are fixed, so nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SET, DELETE = 1, 2

#: An operation: order is (seq, ord); value is null exactly where op is DELETE.
OPS = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
PAIR = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
COLUMNS = OPS.fieldNames()


class StoreError(Exception):
    """Base of all errors of a table."""


class KeyNotFound(StoreError, KeyError):
    """A single-key read met no live key."""


class StoreClosed(StoreError):
    """An operation on a closed handle."""


class CorruptTable(StoreError):
    """A manifest, log or snapshot that fails its checks."""


class CommitConflict(StoreError):
    """Another writer published the next version first."""


def as_bytes(key: bytes | str) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


def key_lit(key: bytes | str) -> Column:
    return F.lit(bytearray(as_bytes(key)))


def canonical(df: DataFrame) -> DataFrame:
    """Operations with the columns and types of OPS. Strings become their UTF-8 bytes.

    A row that is neither a set with a value nor a delete without one, or has no key, fails the query when it
    is read, so a bad batch is never published.
    """
    op = F.col("op").cast("tinyint")
    valid = F.col("key").isNotNull() & (
        ((op == SET) & F.col("value").isNotNull()) | ((op == DELETE) & F.col("value").isNull())
    )
    checked = F.when(valid, op).otherwise(
        F.raise_error(F.lit("an operation needs a key, and a value exactly if it is a set")).cast("tinyint")
    )
    return df.select(
        F.col("seq").cast("long"),
        F.col("ord").cast("int"),
        checked.alias("op"),
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
    )
