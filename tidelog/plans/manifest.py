"""The versioned manifest of a table: which runs are live, published whole or not at all.

Version N is the file manifest-N.json. A writer puts it under a temporary name, makes it durable and then gives
it its name only if that is free, so of two writers of one version one fails. A manifest carries a checksum and
its number of runs; one that fails them is an error, never an empty table, and nothing is swept then.
"""

from __future__ import annotations

import base64
import contextlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from ..schema import CommitConflict, CorruptTable

FORMAT, LEVELS = "tidelog-1", (0, 1, 2)


@dataclass(frozen=True)
class Run:
    path: str  # relative to the table
    level: int
    min_seq: int
    max_seq: int
    min_key: bytes | None
    max_key: bytes | None
    rows: int
    tombstones: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 0
    runs: tuple[Run, ...] = ()
    logical: int = 0
    log: int = 0
    flush: int = 0
    compact: int = 0
    streams: dict[str, int] = field(default_factory=dict)  # the last micro-batch of each query

    def encoded(self) -> bytes:
        def plain(r: Run) -> dict:
            out = asdict(r)
            for k in ("min_key", "max_key"):
                out[k] = None if out[k] is None else base64.b64encode(out[k]).decode()
            return out

        body = {k: v for k, v in asdict(self).items() if k != "runs"}
        body |= {"format": FORMAT, "n_runs": len(self.runs), "runs": [plain(r) for r in self.runs]}
        text = json.dumps(body, sort_keys=True)
        return json.dumps({"crc32": zlib.crc32(text.encode()), "body": text}).encode()

    @staticmethod
    def decoded(raw: bytes) -> Manifest:
        try:
            outer = json.loads(raw)
            text = outer["body"]
            if zlib.crc32(text.encode()) != outer["crc32"]:
                raise ValueError("checksum")
            body = json.loads(text)
            if body.pop("format") != FORMAT or body.pop("n_runs") != len(body["runs"]):
                raise ValueError("format or number of runs")
            runs = []
            for r in body.pop("runs"):
                if r["level"] not in LEVELS:
                    raise ValueError("level")
                for k in ("min_key", "max_key"):
                    r[k] = None if r[k] is None else base64.b64decode(r[k])
                runs.append(Run(**r))
            return Manifest(runs=tuple(runs), **body)
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptTable(f"manifest fails its checks: {e}") from e


class Folder:
    """Files of a table in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        base = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = base.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.root = self.fs.makeQualified(base).toString()
        uri = self.fs.makeQualified(base).toUri()
        self.local = uri.getPath() if uri.getScheme() == "file" else None

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self) -> None:
        self.fs.mkdirs(self.path(""))

    def names(self) -> list[tuple[str, float]]:
        """(name, age in seconds) of what lies in the table's folder."""
        now = self.jvm.System.currentTimeMillis()
        return [(s.getPath().getName(), (now - s.getModificationTime()) / 1000) for s in self.fs.listStatus(self.path(""))]

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def chunks(self, name: str = "", size: int = 4 << 20) -> Iterator[bytes]:
        """A file's bytes, a bounded piece at a time."""
        stream = self.fs.open(self.path(name))
        try:
            while piece := bytes(stream.readNBytes(size)):
                yield piece
        finally:
            stream.close()

    def beside(self) -> str:
        """The path of a new temporary file or folder next to this folder's path; readers of folders pass over its name."""
        top, _, name = self.root.rpartition("/")
        return f"{top}/.{name}.{uuid.uuid4().hex}.tmp"

    def free(self) -> None:
        if self.fs.exists(self.path("")):
            raise CommitConflict(f"{self.root} is taken")

    @contextlib.contextmanager
    def _new(self) -> Iterator:
        """An output stream of the new file that this folder's path names. It has a temporary name until it is durable."""
        self.free()
        part = self.jvm.org.apache.hadoop.fs.Path(self.beside())
        out = self.fs.create(part, False)
        try:
            yield out
            out.hsync()
            out.close()
            if not self.fs.rename(part, self.path("")):
                raise CommitConflict(f"{self.root} is taken")
        except BaseException:
            out.close()
            self.fs.delete(part, False)
            raise

    def stream(self, pieces: Iterable[bytes]) -> None:
        """Write the new file that this folder's path names, from pieces."""
        with self._new() as out:
            held = bytearray()
            for piece in pieces:
                held += piece
                if len(held) >= 1 << 20:
                    out.write(held)
                    held = bytearray()
            out.write(held)

    def join(self, files: Iterable[tuple[str, int]], head: bytes = b"", seal: Callable[[int], bytes] | None = None) -> None:
        """Write the new file that this folder's path names: ``head``, then so many first bytes of each of ``files``, then
        what ``seal`` makes of the CRC-32 of all that. The driver's JVM copies them a buffer at a time; none of them comes
        to Python."""
        crc = self.jvm.java.util.zip.CRC32()
        with self._new() as out:
            checked = self.jvm.java.util.zip.CheckedOutputStream(out, crc)
            checked.write(bytearray(head))
            for name, size in files:
                source = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(name))
                try:
                    if self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, checked, 0, size) != size:
                        raise CorruptTable(f"{name} is shorter than it was")
                finally:
                    source.close()
            if seal:
                checked.write(bytearray(seal(crc.getValue())))
            checked.flush()

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def put_if_absent(self, name: str, raw: bytes) -> None:
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local:
            with open(f"{self.local}/{temporary}", "wb") as f:
                f.write(raw)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{temporary}", f"{self.local}/{name}")
            except FileExistsError as e:
                raise CommitConflict(f"{name} is taken") from e
            finally:
                os.unlink(f"{self.local}/{temporary}")
            folder = os.open(self.local, os.O_RDONLY)
            try:
                os.fsync(folder)
            finally:
                os.close(folder)
            return
        out = self.fs.create(self.path(temporary), False)
        out.write(bytearray(raw))
        out.hsync()
        out.close()
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.context.getClass().getClassLoader() and self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            self.context.rename(self.path(temporary), self.path(name), options)
        except Exception as e:
            self.delete(temporary)
            if self.fs.exists(self.path(name)):
                raise CommitConflict(f"{name} is taken") from e
            raise


def versions(folder: Folder) -> list[int]:
    return sorted(int(m[1]) for name, _ in folder.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", name)))


def load(folder: Folder, version: int | None = None) -> Manifest:
    """The newest manifest, or the one of ``version``; version 0 of a new table is empty."""
    known = versions(folder)
    if version is None:
        version = known[-1] if known else 0
    if version == 0 and not known:
        if any(name.startswith("run-") for name, _ in folder.names()):
            raise CorruptTable("there are runs but no manifest")
        return Manifest()
    if version == 0:
        return Manifest()
    found = Manifest.decoded(folder.read(f"manifest-{version}.json"))
    if found.version != version:
        raise CorruptTable("a manifest is under another's name")
    return found


def publish(folder: Folder, manifest: Manifest) -> None:
    folder.put_if_absent(f"manifest-{manifest.version}.json", manifest.encoded())
