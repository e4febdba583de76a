"""A table of keys and values in a folder: commits, reads, compaction and recovery."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.accounting import amplification, spent
from .operators import checks, lww, read
from .operators.merge import merge
from .plans import compaction
from .plans.manifest import Folder, Manifest, Run, load, publish, versions
from .schema import DELETE, SET, KeyNotFound, StoreClosed, StoreError, as_bytes, canonical
from .sources import runs as run_files

MODES = ("snapshot", "tiered")
#: Asked keys that become a filter of the scan, where bloom filters meet them; and bytes of those that are broadcast.
IN_KEYS, ASKED_BYTES = 10, 32 << 20
#: Runs of several batches that are written together.
AT_ONCE = 8


def _open_only(method):
    @functools.wraps(method)
    def guarded(self, *args, **kwargs):
        if self._closed:
            raise StoreClosed("the table is closed")
        return method(self, *args, **kwargs)

    return guarded


class Table:
    """One handle. Each commit is a new version; a reader keeps the version it opened until refresh(), so no
    commit or compaction changes or blocks its reads. A commit is on disk when it returns, as far as the file
    system keeps what it has acknowledged."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "tiered", version: int | None = None):
        if mode not in MODES:
            raise StoreError(f"mode must be one of {MODES}")
        self.spark, self.mode, self._closed = spark, mode, False
        self.folder = Folder(spark, path)
        self.folder.make()
        self._manifest = load(self.folder, version)

    # -- handle

    @property
    def path(self) -> str:
        return self.folder.root

    @property
    def version(self) -> int:
        return self._manifest.version

    @property
    def runs(self) -> tuple[Run, ...]:
        return self._manifest.runs

    def close(self) -> None:
        """Idempotent. The session stays the caller's."""
        self._closed = True

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @_open_only
    def refresh(self) -> None:
        self._manifest = load(self.folder)

    # -- writes

    def _pairs(self, pairs: Iterable[tuple[bytes | str, bytes | str]]) -> DataFrame:
        rows = [(i, SET, bytearray(as_bytes(k)), bytearray(as_bytes(v))) for i, (k, v) in enumerate(pairs)]
        return self.spark.createDataFrame(rows, "ord int, op tinyint, key binary, value binary")

    def set(self, key: bytes | str, value: bytes | str) -> None:
        self.set_batch([(key, value)])

    def set_batch(self, pairs: DataFrame | Iterable[tuple[bytes | str, bytes | str]]) -> None:
        """One commit. Of a key's rows the last counts: by position, or by the column ord of a DataFrame."""
        ops = pairs.withColumn("op", F.lit(SET)) if isinstance(pairs, DataFrame) else self._pairs(pairs)
        self.apply(ops)

    def delete(self, key: bytes | str) -> None:
        """Also of a key that is not there."""
        self.delete_batch(self.spark.createDataFrame([(bytearray(as_bytes(key)),)], "key binary"))

    def delete_batch(self, keys: DataFrame) -> None:
        self.apply(keys.select(*[c for c in keys.columns if c in ("key", "ord")]).withColumns({"op": F.lit(DELETE), "value": F.lit(None).cast("binary")}))

    @_open_only
    def apply(self, ops: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Commit operations (op, key, value, and ord if keys repeat) as one run of level 0.

        ``stream`` names a streaming query and its micro-batch; a batch at or before the last committed one
        is skipped, so a replayed batch does nothing.
        """
        if stream and self._manifest.streams.get(stream[0], -1) >= stream[1]:
            return
        self._commit(*self._write(ops, self._manifest.next_seq), stream)

    @_open_only
    def apply_all(self, batches: Iterable[DataFrame]) -> None:
        """A commit for each batch, in order, as apply makes them.

        Runs are written ahead, AT_ONCE of them together: a batch that lies close together in its source is read by few
        tasks, which would leave the other cores idle. A run is published in its turn; if one fails, those after it go.
        """
        batches, first = list(batches), self._manifest.next_seq
        with ThreadPoolExecutor(AT_ONCE) as pool:
            ahead = [pool.submit(inheritable_thread_target(self.spark)(self._write), ops, first + i) for i, ops in enumerate(batches)]
            at = 0
            try:
                for at, ops in enumerate(batches):
                    run, cost = ahead[at].result()
                    if run and self._manifest.next_seq != first + at:  # one before it was empty, which is no commit
                        self.folder.delete(run.path)
                        run, cost = self._write(ops, self._manifest.next_seq)
                    self._commit(run, cost)
            except BaseException:
                rest = [f for f in ahead[at + 1 :] if not f.cancel()]
                for f in rest:
                    if f.exception() is None and f.result()[0]:
                        self.folder.delete(f.result()[0].path)
                raise

    def _write(self, ops: DataFrame, seq: int) -> tuple[Run | None, dict[str, int]]:
        """The run of a batch, none if that is empty, and what accounting.spent counts of its operations."""
        if "ord" not in ops.columns:
            ops = ops.withColumn("ord", F.lit(0))
        seen = Observation()
        # the caller's rows are computed once: counted on their way to the shuffle by key, which AQE sizes by bytes. If a
        # lost executor's part is computed again it is counted again; these bytes are for reports
        ops = canonical(ops.withColumn("seq", F.lit(seq))).observe(seen, *spent())
        run = run_files.write(lww.latest(ops), self.folder, self._name(), 0)
        return run, seen.get

    def _commit(self, run: Run | None, cost: dict[str, int], stream: tuple[str, int] | None = None) -> None:
        if run is None and not stream:
            return  # an empty batch is no commit
        base = self._manifest
        streams = base.streams | ({stream[0]: stream[1]} if stream else {})
        self._publish(
            replace(
                base,
                version=base.version + 1,
                next_seq=base.next_seq + 1,
                runs=base.runs + ((run,) if run else ()),
                logical=base.logical + cost["logical_bytes"],
                log=base.log + cost["log_bytes"],
                flush=base.flush + (run.bytes if run else 0),
                streams=streams,
            ),
            [run] if run else [],
        )
        if self.mode == "tiered":
            self._settle()

    def _name(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def _publish(self, manifest: Manifest, new: list[Run]) -> None:
        try:
            publish(self.folder, manifest)
        except Exception:
            for run in new:
                self.folder.delete(run.path)
            raise
        self._manifest = manifest

    # -- compaction

    @_open_only
    def compact(self) -> None:
        """Never changes what is visible. snapshot: all runs become one without tombstones. tiered: level 0
        becomes one run of level 1, then levels with enough runs follow."""
        if self.mode == "snapshot":
            self._merge(list(self.runs), compaction.BOTTOM)
            return
        upper = [r for r in self.runs if r.level == 0]
        if upper:
            self._merge(upper, 1)
        self._settle()

    def _settle(self) -> None:
        while (level := compaction.due(list(self.runs))) is not None:
            self._merge([r for r in self.runs if r.level == level], compaction.below(level))

    def _merge(self, inputs: list[Run], level: int) -> None:
        if not inputs:
            return
        base = self._manifest
        go = compaction.tombstones_may_go(inputs, list(base.runs))
        parts = run_files.parts_for(sum(r.rows for r in inputs), sum(r.bytes for r in inputs))
        dealt = run_files.by_range(run_files.read(self.spark, self.folder, inputs), parts)
        run = run_files.write(merge([dealt], go), self.folder, self._name(), level)
        paths = {r.path for r in inputs}
        self._publish(
            replace(
                base,
                version=base.version + 1,
                runs=tuple(r for r in base.runs if r.path not in paths) + ((run,) if run else ()),
                compact=base.compact + (run.bytes if run else 0),
            ),
            [run] if run else [],
        )

    @_open_only
    def vacuum(self, keep_versions: int = 1, older_than_s: float = 3600) -> list[str]:
        """Delete runs and temporary files that none of the newest ``keep_versions`` manifests names, if old
        enough not to be a commit under way. Every manifest to keep is checked first; if one fails, nothing goes."""
        known = versions(self.folder)
        kept = known[-keep_versions:] if keep_versions else []
        named = {r.path for v in kept for r in load(self.folder, v).runs} | {f"manifest-{v}.json" for v in kept}
        gone = [n for n, age in self.folder.names() if n not in named and age >= older_than_s and n.startswith((".", "run-", "manifest-"))]
        for name in gone:
            self.folder.delete(name)
        return gone

    # -- reads

    def _ops(self, runs: list[Run], seq: int | None = None) -> DataFrame:
        ops = run_files.read(self.spark, self.folder, runs)
        return ops if seq is None else lww.as_of(ops, seq)

    @_open_only
    def operations(self) -> DataFrame:
        return self._ops(list(self.runs))

    @_open_only
    def view(self, seq: int | None = None) -> DataFrame:
        """(key, value) of all live keys, or of those live after commit ``seq`` as far as compaction has kept it."""
        return lww.visible(self._ops(list(self.runs), seq))

    @_open_only
    def scan(self, start: bytes | str = b"", end: bytes | str = b"") -> DataFrame:
        chosen = compaction.prune(list(self.runs), as_bytes(start), as_bytes(end) or None)
        return read.scan(lww.visible(self._ops(chosen)), start, end)

    @_open_only
    def prefix_scan(self, prefix: bytes | str) -> DataFrame:
        return self.scan(prefix, read.successor(prefix))

    @_open_only
    def get(self, key: bytes | str) -> bytes:
        chosen = compaction.prune(list(self.runs), key=as_bytes(key))
        rows = read.get(lww.visible(self._ops(chosen)), key).collect()
        if not rows:
            raise KeyNotFound(as_bytes(key))
        return bytes(rows[0]["value"])

    @_open_only
    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value, found) for every row of ``keys``.

        The keys are measured first. Runs and row groups outside their range are not read; and if they are few, or
        ASKED_BYTES at most, they are sent to the scan, so that only their versions are shuffled.
        """
        asked = keys.select("key").distinct()
        size = asked.agg(
            F.count("key").alias("n"), F.sum(F.octet_length("key")).alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")
        ).first()
        if not size["n"]:
            return read.multi_get(self.view().limit(0), keys)
        lo, hi = as_bytes(size["lo"]), as_bytes(size["hi"])
        ops = self._ops(compaction.prune(list(self.runs), lo, hi + b"\0")).where(F.col("key").between(read.key_lit(lo), read.key_lit(hi)))
        if size["n"] <= IN_KEYS:
            ops = ops.where(F.col("key").isin([bytearray(r["key"]) for r in asked.where("key is not null").collect()]))
        elif size["bytes"] + 16 * size["n"] <= ASKED_BYTES:
            ops = ops.join(F.broadcast(asked), "key", "left_semi")
        return read.multi_get(lww.visible(ops), keys)

    @_open_only
    def count(self) -> int:
        return read.count(self.view()).first()["n_live"]

    # -- reports

    @_open_only
    def run_metadata(self) -> DataFrame:
        return run_files.metadata(self.spark, list(self.runs))

    @_open_only
    def stats(self) -> dict[str, int]:
        m = self._manifest
        return {"logical": m.logical, "log": m.log, "flush": m.flush, "compact": m.compact}

    @_open_only
    def write_amplification(self) -> float:
        """Bytes written for each logical byte. A commit's run is its log, so log bytes are not counted twice."""
        m = self._manifest
        row = self.spark.range(1).select(
            amplification(F.lit(m.logical), F.lit(0), F.lit(m.flush), F.lit(m.compact)).alias("x")
        )
        return row.first()["x"]

    @_open_only
    def check(self) -> dict[str, int]:
        """Violations by name, over all operations and each run."""
        found = {r["check_name"]: r["violations"] for r in checks.report(self.operations()).collect()}
        for run in self.runs:
            for r in checks.run_report(run_files.read(self.spark, self.folder, [run]), run.min_key, run.max_key, run.rows).collect():
                found[r["check_name"]] = found.get(r["check_name"], 0) + r["violations"]
            for r in checks.file_report(self.spark, f"{self.folder.root}/{run.path}", run.level > 0).collect():
                found[r["check_name"]] = found.get(r["check_name"], 0) + r["violations"]
        return found
