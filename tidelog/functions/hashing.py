"""Checksums and probe positions of keys, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DELETE

LOW = (1 << 32) - 1


def big_endian(n: Column, size: int) -> Column:
    """The low ``size`` bytes of a number, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def payload() -> Column:
    """Type, length of key and of value, key, value; a delete has no value."""
    value = F.when(F.col("op") == DELETE, F.lit(bytearray())).otherwise(F.coalesce("value", F.lit(bytearray())))
    return F.concat(
        big_endian(F.col("op"), 1),
        big_endian(F.octet_length("key"), 4),
        big_endian(F.octet_length(value), 4),
        F.col("key"),
        value,
    )


def framed() -> Column:
    """A whole log record: length and CRC-32 of the payload, then the payload."""
    return F.concat(big_endian(F.octet_length(payload()), 4), big_endian(F.crc32(payload()), 4), payload())


def fnv1a(key: Column) -> Column:
    """FNV-1a, 32 bits, as a long. The empty key has no bytes to fold."""
    places = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(
        places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(LOW))
    )


def times32(a: Column, b: int) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, in halves so that no product overflows a long."""
    high = F.shiftright(a, 16).bitwiseAND(F.lit(0xFFFF)) * F.lit(b)
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)).bitwiseAND(F.lit(LOW))


def probes(key: Column, bits: Column) -> Column:
    """Three places of a key in a filter of ``bits`` bits."""
    first, second = fnv1a(key), F.crc32(key)
    third = first.bitwiseXOR(times32(second, 0x9E3779B1))
    return F.array(*(F.pmod(h, bits.cast("long")) for h in (first, second, third)))


def filter_bits(n_keys: Column) -> Column:
    """Ten bits a key, 64 at least."""
    return F.greatest(F.lit(64), 10 * n_keys).cast("long")
