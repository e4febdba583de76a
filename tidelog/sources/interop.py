"""Other on-disk forms: framed binary logs and hexadecimal text snapshots."""

from __future__ import annotations

import contextlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.manifest import Folder
from ..schema import DELETE, SET, CorruptTable

HEADER = "SNAPSHOT v2"
#: The file of a snapshot folder that says it is whole; Spark's readers pass over names that begin so.
SEAL = "_SNAPSHOT"
#: Records of a log that travel together; and bits of a sequence number for the offset in its segment.
TOGETHER, OFFSET_BITS = 1 << 16, 40
#: Bytes of a segment, which a task holds as a whole when it reads it.
SEGMENT_BYTES = 16 << 20


def parse_log(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(offset, op, key, value) of the longest intact prefix: it ends at a short header or payload, a wrong
    checksum or lengths that don't add up. An operation of unknown type is an error."""
    at = 0
    raw = memoryview(raw)
    while at + 8 <= len(raw):
        size, crc = struct.unpack_from(">II", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or size < 9 or zlib.crc32(body) != crc:
            return
        op, klen, vlen = struct.unpack_from(">BII", body)
        if size != 9 + klen + vlen:
            return
        if op not in (SET, DELETE):
            raise CorruptTable(f"unknown operation {op} at byte {at}")
        yield at, op, bytes(body[9 : 9 + klen]), bytes(body[9 + klen :]) if op == SET else None
        at += 8 + size


def segments(spark: SparkSession, path: str) -> list[str]:
    """The files of a log in order: one file, or a folder's by name."""
    folder = Folder(spark, path)
    if folder.fs.getFileStatus(folder.path("")).isFile():
        return [folder.root]
    return [f"{folder.root}/{n}" for n in sorted(n for n, _ in folder.names() if not n.startswith(("_", ".")))]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Operations (ord = 0) of a binary log: a file, or a folder of segments in the order of their names.

    seq is the segment's place and the byte offset in it, so operations of several segments have one order. The log
    ends at the first damaged record, wherever it is: segments after it are left out, as a replay would.
    Records have no marks to split at, so one task reads one segment, as Spark's binaryFile source hands it out.
    """
    files = segments(spark, path)
    place = {f.rpartition("/")[2]: i for i, f in enumerate(files)}
    schema = "seq long, ord int, op tinyint, key binary, value binary"
    if not files:
        return spark.createDataFrame([], schema)
    content = lambda names: spark.read.format("binaryFile").load(names).select("path", "content")

    def damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, end = raw.as_py(), 0
                for at, _, key, value in parse_log(raw):
                    end = at + 17 + len(key) + len(value or b"")
                if end < len(raw):
                    yield pa.record_batch([pa.array([place[name.rpartition("/")[2]]], pa.int32())], ["place"])

    if len(files) > 1:
        cut = content(files).mapInArrow(damage, "place int").agg(F.min("place").alias("cut")).first()["cut"]
        files = files if cut is None else files[: cut + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                first = place[name.rpartition("/")[2]] << OFFSET_BITS
                records = parse_log(raw.as_py())
                while rows := list(islice(records, TOGETHER)):
                    yield pa.record_batch(
                        [
                            pa.array([first + r[0] for r in rows], pa.int64()),
                            pa.array([0] * len(rows), pa.int32()),
                            pa.array([r[1] for r in rows], pa.int8()),
                            pa.array([r[2] for r in rows], pa.binary()),
                            pa.array([r[3] for r in rows], pa.binary()),
                        ],
                        ["seq", "ord", "op", "key", "value"],
                    )

    return content(files).mapInArrow(run, schema)


@contextlib.contextmanager
def _staged(lines: DataFrame, folder: Folder, extra: int = 0) -> Iterator[list[tuple[str, int]]]:
    """(file, bytes) in order of partitions, of lines that executors have written next to the path of ``folder``; the
    files go at the end. ``extra`` bytes at each file's end are not counted."""
    top = Folder(lines.sparkSession, folder.beside())
    try:
        lines.write.options(compression="none", lineSep="\n", maxRecordsPerFile="0").text(top.root)
        found = [(s.getPath(), s.getLen()) for s in top.fs.listStatus(top.path(""))]
        parts = [(int(m[1]), p.toString(), n - extra) for p, n in found if n and (m := re.match(r"part-(\d+)", p.getName()))]
        yield [(p, n) for _, p, n in sorted(parts)]
    finally:
        top.delete("")


def _frames(ops: DataFrame) -> DataFrame:
    """Framed records as lines for the text writer, in order of (seq, ord), a file's worth of SEGMENT_BYTES or so in each
    partition.

    The writer puts a newline behind each line. Lines end where the records have that byte, so it is one of theirs,
    but for the last line of a partition, which makes its file one byte longer than its records."""
    from ..functions import accounting, hashing

    size = accounting.written(ops).first()["log_bytes"]
    dealt = ops.repartitionByRange(max(1, ceil(size / SEGMENT_BYTES)), "seq", "ord").sortWithinPartitions("seq", "ord")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda raw: pa.record_batch([pa.array([raw], pa.binary())], ["line"])
        held, any_rows = [], False
        for batch in batches:
            any_rows = any_rows or batch.num_rows > 0
            whole, newline, rest = b"".join(batch.column(0).to_pylist()).rpartition(b"\n")
            if newline:
                yield line(b"".join([*held, whole]))
                held = []
            held.append(rest)
        if any_rows:
            yield line(b"".join(held))

    return dealt.select(hashing.framed().alias("frame")).mapInArrow(cut, "line binary").select(F.col("line").cast("string"))


def write_log(ops: DataFrame, path: str) -> None:
    """One segment of framed records, in order of (seq, ord), as a new file. Executors frame and write them in parts, which
    the driver's JVM copies behind each other, as a file has one writer; no record is sent to the driver."""
    folder = Folder(ops.sparkSession, path)
    folder.free()
    with _staged(_frames(ops), folder, 1) as files:
        folder.join(files)


def write_segments(ops: DataFrame, path: str, prefix: str = "") -> list[str]:
    """The same as segments of about SEGMENT_BYTES, which read_log reads in as many tasks: the new files' paths, named by
    ``prefix`` and their place in the folder ``path``. They appear in order, so a log that was not finished is a prefix."""
    top = Folder(ops.sparkSession, path)
    top.make()
    names = []
    with _staged(_frames(ops), Folder(ops.sparkSession, f"{top.root}/{prefix}"), 1) as files:
        for i, file in enumerate(files):
            names.append(f"{top.root}/{prefix}{i:09d}")
            Folder(ops.sparkSession, names[-1]).join([file])
    return names


def hex_lines(view: DataFrame) -> DataFrame:
    """(line) for each pair: lower-case hex of key and value with a tab between."""
    return view.select(F.concat_ws("\t", F.lower(F.hex("key")), F.lower(F.hex("value"))).alias("line"))


def _sums(lines: DataFrame, column: str) -> dict[str, int]:
    """How many lines, and the sum of their checksums, which is the same in any order of files."""
    s = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.crc32(column).cast("decimal(38,0)")), F.lit(0)).alias("crc")).first()
    return {"lines": s["n"], "checksum": int(s["crc"])}


def write_snapshot(view: DataFrame, path: str) -> None:
    """A folder of text files in key order: lines of pairs of any length. A seal with their number and checksum is put
    there last, so an unfinished, truncated or altered snapshot is told from a whole one."""
    hex_lines(view.orderBy("key")).write.text(path)
    written = _sums(view.sparkSession.read.text(path), "value")
    Folder(view.sparkSession, path).put_if_absent(SEAL, json.dumps({"format": HEADER} | written).encode())


def export_snapshot(view: DataFrame, path: str) -> None:
    """The same as one file: a header, the lines in key order, and the CRC-32 of all before it. It takes its name when it
    is whole. Executors write the lines in parts, which the driver's JVM copies behind each other."""
    folder = Folder(view.sparkSession, path)
    folder.free()
    with _staged(hex_lines(view.orderBy("key")), folder) as files:
        folder.join(files, f"{HEADER}\n".encode(), lambda crc: f"CHECKSUM {crc}\n".encode())


def _pairs(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    good = F.col("value").rlike(r"^([0-9a-fA-F]{2})*\t([0-9a-fA-F]{2})*$")
    line = F.when(good, parts).otherwise(F.raise_error(F.lit("a snapshot line is damaged")).cast("array<string>"))
    return lines.select(F.unhex(line[0]).alias("key"), F.unhex(line[1]).alias("value"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a snapshot folder or of a snapshot in one file. One that has no seal or header, or whose lines
    are not those it was sealed with, is CorruptTable here; a damaged base is never taken for a smaller one."""
    folder = Folder(spark, path)
    if folder.fs.getFileStatus(folder.path("")).isFile():
        return _read_file(spark, folder)
    if not folder.fs.exists(folder.path(SEAL)):
        raise CorruptTable("the snapshot has no seal: it is unfinished")
    try:
        seal = json.loads(folder.read(SEAL))
        wanted = {k: seal[k] for k in ("lines", "checksum")}
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptTable("the snapshot's seal is damaged") from e
    if seal.get("format") != HEADER:
        raise CorruptTable("not a snapshot")
    lines = spark.read.text(path)
    if _sums(lines, "value") != wanted:
        raise CorruptTable("the snapshot's checksum does not hold")
    return _pairs(lines)


def _read_file(spark: SparkSession, folder: Folder) -> DataFrame:
    """The checksum runs over the bytes in order, so it is taken in one stream; the pairs are then read by Spark."""
    crc, end, first, last = 0, b"", None, b""
    for chunk in folder.chunks():
        end += chunk
        *whole, end = end.split(b"\n")
        for line in whole:
            if first is None:
                first = line
                crc = zlib.crc32(line + b"\n")
                continue
            if last:
                crc = zlib.crc32(last, crc)
            last = line + b"\n"
    if first != HEADER.encode():
        raise CorruptTable("invalid snapshot header")
    if end or not last.startswith(b"CHECKSUM ") or not last[9:-1].isdigit():
        raise CorruptTable("the snapshot has no checksum: it is truncated")
    if int(last[9:]) != crc:
        raise CorruptTable("the snapshot's checksum does not hold")
    lines = spark.read.text(folder.root)
    return _pairs(lines.where(~F.col("value").startswith(HEADER) & ~F.col("value").startswith("CHECKSUM ")))
