"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; a longer single row still travels alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of long texts does not fill a worker.

    These two settings of the session stay so, as Spark reads them when the result is computed, which is later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one in spark.checkpoint.dir. Only on one machine, as in tests, may that be unset; a temporary
    folder is used then.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share: that of checkpoints."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        conf = context.getConf()
        folder = conf.get("spark.checkpoint.dir")
        if folder is None:
            if not conf.get("spark.master", "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class Stored:
    """Intermediate results as compressed tables in the shared folder; they outlive lost executors, and what is not
    dropped goes when the session ends.

    After each, shuffles of finished steps are let go: Spark drops them once the driver's objects that
    refer to them are collected, which would else happen some time later.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        target, files = self._at(path)
        files.deleteOnExit(target)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        del df
        self.release()
        return out

    def release(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            target, files = self._at(self.paths.pop(id(t))[1])
            files.delete(target, True)

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())


def crc_remainder(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and n+1 offsets into it; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, or the bytes of a binary column; null is empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a worker for later tasks, which may be quite others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable) -> Callable:
    """A function of mapInArrow that gives memory back when its task is done."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def frugal_group(run: Callable) -> Callable:
    """The same for a function of groups."""

    @functools.wraps(run)
    def one(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    @functools.wraps(run)
    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return one if run.__code__.co_argcount == 1 else two


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Map every Arrow batch of ``df`` on its own."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(frugal(run), schema)


def sized_slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together; a longer row is a run of its own."""
    start, n = 0, len(bounds) - 1
    while start < n:
        stop = int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def sampled_rows(labelled: DataFrame, label: str, each: int) -> DataFrame:
    """A bounded sample: about ``each`` rows of every label, chosen by a hash of all their columns.

    The share taken of each label follows from one count of all labelled rows, so the sample has the
    same size at every scale. Below ``each`` rows, all are taken. However many rows are equal, and so
    share a hash, at most 1.5 times what is meant comes back.
    """
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    spread = F.pmod(F.xxhash64(*labelled.columns), F.lit(1 << 30)) / float(1 << 30)
    most = ceil(1.5 * sum(min(each, n) for n in counts.values()))
    return labelled.withColumn("_spread", spread).where(F.col("_spread") < share).orderBy("_spread").limit(most).drop("_spread")


# -- hashes of many short strings at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
#: A random number for each byte value.
BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64: with them a sum over the bytes up to a place gives
    the hash of any stretch as a difference."""
    if not _POWERS or len(_POWERS[0]) < n:
        ones = lambda b: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, b, np.uint64))])
        _POWERS[:] = [ones(_BASE), ones(_INVERSE)]
    return _POWERS[0], _POWERS[1]


# -- packed arrays: what tasks exchange instead of a row for each number

_CODEC = pa.Codec("zstd", compression_level=1)


def planes(values: np.ndarray) -> bytes:
    """An array, bytes of like weight side by side, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes() if len(values) else b""
    return _CODEC.compress(raw, asbytes=True)


def unplaned(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(_CODEC.decompress(data, n * width, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their number and their differences."""
    return len(keys).to_bytes(8, "little") + planes(np.diff(keys, prepend=np.uint64(0)))


def packed_size(data: bytes) -> int:
    return int.from_bytes(data[:8], "little")


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data[8:], packed_size(data), np.uint64), dtype=np.uint64)


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each value of sorted ``keys`` begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def dealt(keys: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys, in order)."""
    order = np.argsort(part, kind="stable")
    first = np.append(starts(part[order]), len(order))
    for a, b in zip(first.tolist(), first[1:].tolist()):
        yield int(part[order[a]]), order[a:b]
