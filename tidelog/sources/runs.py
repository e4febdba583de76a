"""Sorted runs: Parquet sorted by key within files, with bloom filters on the key."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.manifest import Folder, Run
from ..schema import COLUMNS, DELETE, OPS

#: Rows and bytes of a file, and rows of a page, which is the grain of skipping inside a file.
FILE_ROWS, FILE_BYTES, PAGE_ROWS = 1_000_000, 128 << 20, 4096
#: Bytes of a file's bloom filter at most; it is made as small as its keys allow.
BLOOM_BYTES = 4 << 20


def parts_for(rows: int, size: int) -> int:
    """Files for about so many rows and bytes."""
    return max(1, ceil(rows / FILE_ROWS), ceil(size / FILE_BYTES))


def by_range(ops: DataFrame, parts: int) -> DataFrame:
    """Operations dealt by key range. An aggregate by key after it needs no other shuffle, and leaves them sorted."""
    return ops.repartitionByRange(parts, "key")


def write(df: DataFrame, folder: Folder, name: str, level: int) -> Run | None:
    """Write a run of one version for each key, in as many files as ``df`` has partitions.

    Its statistics are taken of the rows on their way to the files; nothing is read again. None comes back if
    nothing was written.
    """
    seen = Observation()
    observed = df.select(*COLUMNS).sortWithinPartitions("key").observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("op") == DELETE).alias("dead"),
        *(f(c).alias(f"{f.__name__}_{c}") for c in ("seq", "key") for f in (F.min, F.max)),
    )
    (
        observed.write.option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.bloom.filter.max.bytes", str(BLOOM_BYTES))
        .option("parquet.bloom.filter.candidates.number", "10")
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("parquet.page.write-checksum.enabled", "true")
        .parquet(f"{folder.root}/{name}")
    )
    s = seen.get
    if not s["n"]:
        folder.delete(name)
        return None
    return Run(
        name, level, s["min_seq"], s["max_seq"], bytes(s["min_key"]), bytes(s["max_key"]), s["n"], s["dead"], folder.size(name)
    )


def read(spark: SparkSession, folder: Folder, runs: list[Run]) -> DataFrame:
    """The operations of several runs as one scan, so filters and column choice reach each file."""
    if not runs:
        return spark.createDataFrame([], OPS)
    return spark.read.schema(OPS).parquet(*(f"{folder.root}/{r.path}" for r in runs))


def metadata(spark: SparkSession, runs: list[Run]) -> DataFrame:
    rows = [(r.level, r.max_seq, r.path, r.min_key, r.max_key, r.rows, r.tombstones, r.bytes) for r in runs]
    return spark.createDataFrame(
        rows, "level int, seq long, path string, min_key binary, max_key binary, n_rows long, n_tombstones long, bytes long"
    )
