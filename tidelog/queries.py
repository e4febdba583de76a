"""Queries over the driver's tables, each with the SQL that gives the same rows.

The log is derived from events: the key is the user, the sequence is the event's id, an event of type error
deletes. Runs are eight stretches of the sequence; pairs are orders by their key.
"""

from __future__ import annotations

import contextlib
import io
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions import accounting, hashing
from .operators import checks, lww, merge, read
from .plans import compaction
from .plans.manifest import Folder, load, versions
from .schema import DELETE, SET, StoreError, canonical
from .sources import interop
from .sources.interop import hex_lines
from .sources.scratch import shared_folder
from .streaming import ingest
from .table import Table

RUNS = 8
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- derived logs


def log(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """Operations from events; the finer key adds the event's properties."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.format_string("user%06d", "user_id")
    key = F.concat(user, F.lit("/"), F.substring("props", 7, 1 << 20)) if fine else user
    dead = F.col("event_type") == "error"
    return canonical(
        events.select(
            F.col("event_id").alias("seq"),
            F.lit(0).alias("ord"),
            F.when(dead, F.lit(DELETE)).otherwise(F.lit(SET)).alias("op"),
            key.alias("key"),
            F.when(~dead, F.concat("event_type", F.lit(":"), "props")).alias("value"),
        )
    )


def run_of(spark: SparkSession, sf_dir: str) -> Column:
    """The run of an operation: the sequence cut into RUNS stretches."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return F.floor(F.col("seq") / F.lit(-(-n // RUNS))).cast("int")


def middle(spark: SparkSession, sf_dir: str, share: float = 0.5) -> int:
    return int(spark.read.parquet(f"{sf_dir}/events.parquet").count() * share)


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("key", "value")})


OPS_SQL = """
WITH ops AS (
  SELECT event_id AS seq, printf('user%06d', user_id) AS key, event_type = 'error' AS dead,
    CASE WHEN event_type <> 'error' THEN event_type || ':' || props END AS value,
    (event_id // (((SELECT count(*) FROM events) + 7) // 8))::INTEGER AS run
  FROM events
), newest AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
visible AS (SELECT key, value FROM newest WHERE NOT dead)
"""
VISIBLE_SQL = OPS_SQL + "SELECT key, value FROM visible"
NEWEST_SQL = OPS_SQL + "SELECT key, seq, dead, value FROM newest"


def newest_rows(df: DataFrame) -> DataFrame:
    return text(df).select("key", "seq", (F.col("op") == DELETE).alias("dead"), "value")


# -- views and reads


@query(VISIBLE_SQL)
def visible_scan(spark, sf_dir):
    return text(read.scan(lww.visible(log(spark, sf_dir))))


@query(VISIBLE_SQL + " WHERE key >= 'user000010' AND key < 'user000050'")
def scan_range(spark, sf_dir):
    return text(read.scan(lww.visible(log(spark, sf_dir)), "user000010", "user000050"))


@query(VISIBLE_SQL + " WHERE key >= 'user000050'")
def scan_unbounded_end(spark, sf_dir):
    return text(read.scan(lww.visible(log(spark, sf_dir)), "user000050", ""))


@query(VISIBLE_SQL + " WHERE key >= 'user000050' AND key < 'user000010'")
def scan_empty_range(spark, sf_dir):
    return text(read.scan(lww.visible(log(spark, sf_dir)), "user000050", "user000010"))


@query(VISIBLE_SQL + " WHERE key = 'user000042'")
def get_point(spark, sf_dir):
    return text(read.get(lww.visible(log(spark, sf_dir)), "user000042"))


def asked_keys(spark: SparkSession) -> DataFrame:
    return spark.range(0, 300, 3).select(F.format_string("user%06d", "id").cast("binary").alias("key"))


@query(
    OPS_SQL
    + """, asked AS (SELECT printf('user%06d', i) AS key FROM range(0, 300, 3) t(i))
SELECT a.key, v.value, v.key IS NOT NULL AS found FROM asked a LEFT JOIN visible v ON a.key = v.key"""
)
def multi_get(spark, sf_dir):
    return text(read.multi_get(lww.visible(log(spark, sf_dir)), asked_keys(spark)))


@query(
    OPS_SQL
    + """, asked AS (SELECT printf('user%06d', i) AS key FROM range(0, 300, 3) t(i))
SELECT key FROM asked WHERE NOT EXISTS (SELECT 1 FROM visible v WHERE v.key = asked.key)"""
)
def get_missing_keys(spark, sf_dir):
    return text(read.missing(lww.visible(log(spark, sf_dir)), asked_keys(spark)), "key")


@query(VISIBLE_SQL + " WHERE key >= 'user0000' AND key < 'user0001'")
def prefix_scan(spark, sf_dir):
    return text(read.prefix_scan(lww.visible(log(spark, sf_dir)), "user0000"))


@query(OPS_SQL + "SELECT count(*)::BIGINT AS n_live FROM visible")
def live_count(spark, sf_dir):
    return read.count(lww.visible(log(spark, sf_dir)))


# -- writes


@query(NEWEST_SQL)
def upsert_lww(spark, sf_dir):
    return newest_rows(lww.latest(log(spark, sf_dir)))


@query(OPS_SQL + "SELECT key, seq FROM newest WHERE dead")
def deletes_effective(spark, sf_dir):
    return text(lww.deleted(log(spark, sf_dir)), "key")


@query(
    OPS_SQL
    + """, before AS (SELECT *, lag(dead) OVER (PARTITION BY key ORDER BY seq) AS was FROM ops)
SELECT key, seq, coalesce(NOT was, false) AS hit FROM before WHERE dead"""
)
def delete_hit_flag(spark, sf_dir):
    return text(lww.delete_hits(log(spark, sf_dir)), "key")


@query(
    OPS_SQL
    + """SELECT seq // 100 AS batch, key, seq, dead, value FROM ops
QUALIFY row_number() OVER (PARTITION BY seq // 100, key ORDER BY seq DESC) = 1"""
)
def set_batch_dedupe(spark, sf_dir):
    batched = log(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 100).cast("long"))
    return text(lww.batch_last(batched, "batch")).select("batch", "key", "seq", (F.col("op") == DELETE).alias("dead"), "value")


# -- runs, compaction, recovery


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight runs as one scan, each with one version for a key; run tells which."""
    return lww.batch_last(log(spark, sf_dir).withColumn("run", run_of(spark, sf_dir)), "run")


@query(NEWEST_SQL)
def merge_runs(spark, sf_dir):
    return newest_rows(merge.merge([runs_of(spark, sf_dir)], drop_tombstones=False))


@query(VISIBLE_SQL)
def compact_partial_keep_tombstones(spark, sf_dir):
    runs = runs_of(spark, sf_dir)
    upper = merge.merge([runs.where("run >= 4")], drop_tombstones=False)
    return text(lww.visible(merge.merge([runs.where("run < 4").drop("run"), upper], drop_tombstones=False)))


@query(VISIBLE_SQL)
def compact_full_drop_tombstones(spark, sf_dir):
    return text(merge.merge([runs_of(spark, sf_dir)], drop_tombstones=True).select("key", "value"))


@query(VISIBLE_SQL)
def snapshot_plus_log(spark, sf_dir):
    ops, half = log(spark, sf_dir), middle(spark, sf_dir)
    base = merge.merge([ops.where(F.col("seq") < half)], drop_tombstones=True)
    return text(lww.visible(merge.recover(base, ops.where(F.col("seq") >= half))))


@query(VISIBLE_SQL)
def replay_idempotent(spark, sf_dir):
    ops, half, quarter = log(spark, sf_dir), middle(spark, sf_dir), middle(spark, sf_dir, 0.25)
    base = merge.merge([ops.where(F.col("seq") < half)], drop_tombstones=True)
    return text(lww.visible(merge.recover(base, ops.where(F.col("seq") >= quarter))))


AS_OF_SQL = OPS_SQL + """SELECT key, value FROM (
  SELECT * FROM ops WHERE seq <= (SELECT count(*) FROM events) // 2
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT dead"""


@query(AS_OF_SQL)
def as_of_read(spark, sf_dir):
    return text(lww.visible(lww.as_of(log(spark, sf_dir), middle(spark, sf_dir))))


@query(
    OPS_SQL
    + """SELECT seq, key, dead, value FROM ops WHERE seq < (SELECT min(seq) FROM ops WHERE seq % 997 = 500)"""
)
def valid_log_prefix(spark, sf_dir):
    return newest_rows(merge.valid_prefix(log(spark, sf_dir), F.pmod("seq", F.lit(997)) != 500))


@query(
    OPS_SQL
    + """, cut AS (SELECT min(seq) AS cut_at FROM ops WHERE seq % 997 = 500)
SELECT cut_at, count(*) FILTER (cut_at IS NULL OR seq < cut_at) AS n_kept, count(*) FILTER (seq >= cut_at) AS n_dropped
FROM ops, cut GROUP BY cut_at"""
)
def dropped_log_report(spark, sf_dir):
    return merge.dropped_report(log(spark, sf_dir), F.pmod("seq", F.lit(997)) != 500)


# -- a real table of the log, in a folder


_TABLES: dict[tuple[str, str, str], str] = {}


def log_table(spark: SparkSession, sf_dir: str, mode: str = "snapshot") -> Table:
    """The log as a table of RUNS commits, opened anew. It is made once in a session; who writes to it takes fresh_table."""
    name = (spark.sparkContext.applicationId, sf_dir, mode)
    if name not in _TABLES:
        _TABLES[name] = fresh_table(spark, sf_dir, mode).path
    return Table(spark, _TABLES[name], mode)


def fresh_table(spark: SparkSession, sf_dir: str, mode: str) -> Table:
    table = Table(spark, f"{shared_folder(spark)}/table", mode)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    ops, width = log(spark, sf_dir), -(-n // RUNS)
    parts = (ops.where((F.col("seq") >= i * width) & (F.col("seq") < (i + 1) * width)) for i in range(RUNS))
    table.apply_all(part.select("op", "key", "value", F.col("seq").cast("int").alias("ord")) for part in parts)
    return table


L0_SQL = OPS_SQL + """, l0 AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1),
stats AS (SELECT run, min(key) AS min_key, max(key) AS max_key, count(*) AS n_rows, count(*) FILTER (dead) AS n_tombstones FROM l0 GROUP BY run)
"""


@query(VISIBLE_SQL)
def table_reopened(spark, sf_dir):
    return text(log_table(spark, sf_dir).view())


@query(VISIBLE_SQL)
def table_tiered(spark, sf_dir):
    """After eight commits, which level 0 was merged twice in between."""
    return text(log_table(spark, sf_dir, "tiered").view())


@query(OPS_SQL + "SELECT v.level, v.n_runs FROM (VALUES (0, 0), (1, 2), (2, 0)) v(level, n_runs)")
def table_tiered_levels(spark, sf_dir):
    runs = log_table(spark, sf_dir, "tiered").runs
    return spark.createDataFrame([(i, sum(r.level == i for r in runs)) for i in range(3)], "level int, n_runs int")


@query(OPS_SQL + "SELECT 1 AS n_runs, 0 AS n_tombstones, count(*)::BIGINT AS n_rows FROM visible")
def table_compacted_runs(spark, sf_dir):
    table = fresh_table(spark, sf_dir, "snapshot")
    table.compact()
    again = Table(spark, table.path).run_metadata()
    return again.agg(
        F.count(F.lit(1)).cast("int").alias("n_runs"), F.sum("n_tombstones").cast("int").alias("n_tombstones"), F.sum("n_rows").alias("n_rows")
    )


@query(VISIBLE_SQL)
def table_compacted_rows(spark, sf_dir):
    """Compaction leaves what was visible, and nothing else, in its run."""
    table = fresh_table(spark, sf_dir, "snapshot")
    table.compact()
    return text(Table(spark, table.path).operations().select("key", "value"))


@query(VISIBLE_SQL + " WHERE key >= 'user000010' AND key < 'user000050'")
def table_scan(spark, sf_dir):
    return text(log_table(spark, sf_dir).scan("user000010", "user000050"))


@query(VISIBLE_SQL + " WHERE key = (SELECT min(key) FROM visible)")
def table_get(spark, sf_dir):
    table = log_table(spark, sf_dir, "tiered")
    key = bytes(table.view().agg(F.min("key").alias("k")).first()["k"])
    return spark.createDataFrame([(key.decode(), table.get(key).decode())], "key string, value string")


ASKED_SQL = OPS_SQL + """, asked AS (SELECT printf('user%06d', i) AS key FROM range(0, 300, 3) t(i))
"""


@query(ASKED_SQL + "SELECT a.key, v.value, v.key IS NOT NULL AS found FROM asked a LEFT JOIN visible v ON a.key = v.key")
def table_multi_get(spark, sf_dir):
    return text(log_table(spark, sf_dir).multi_get(asked_keys(spark)))


@query(ASKED_SQL + "SELECT a.key, v.value, v.key IS NOT NULL AS found FROM asked a LEFT JOIN visible v ON a.key = v.key WHERE a.key < 'user000015'")
def table_multi_get_few(spark, sf_dir):
    """So few keys that they are a filter of the scan."""
    return text(log_table(spark, sf_dir).multi_get(asked_keys(spark).where(F.col("key") < F.lit(bytearray(b"user000015")))))


@query(ASKED_SQL + "SELECT key, value FROM visible WHERE key NOT IN (SELECT key FROM asked)")
def table_delete_batch(spark, sf_dir):
    table = fresh_table(spark, sf_dir, "tiered")
    table.delete_batch(asked_keys(spark))
    return text(table.view())


@query(
    """SELECT printf('order%09d', l_orderkey) AS key, max(l_linenumber)::VARCHAR AS value
FROM lineitem GROUP BY l_orderkey"""
)
def table_set_batch(spark, sf_dir):
    """One commit in which keys repeat: the last line of an order wins."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = lines.select(
        F.format_string("order%09d", "l_orderkey").alias("key"),
        F.col("l_linenumber").cast("string").alias("value"),
        F.col("l_linenumber").alias("ord"),
    )
    table = Table(spark, f"{shared_folder(spark)}/table")
    table.set_batch(pairs)
    return text(table.view())


@query(AS_OF_TABLE_SQL := OPS_SQL + """SELECT key, value FROM (SELECT * FROM ops WHERE run <= 3
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT dead""")
def table_as_of(spark, sf_dir):
    """What was live after the fourth commit."""
    return text(log_table(spark, sf_dir).view(seq=3))


@query(AS_OF_TABLE_SQL)
def table_pinned_version(spark, sf_dir):
    """The same by opening the manifest of that commit."""
    return text(Table(spark, log_table(spark, sf_dir).path, version=4).view())


@query(OPS_SQL + "SELECT count(*)::BIGINT AS n_live FROM visible")
def table_count(spark, sf_dir):
    return spark.createDataFrame([(log_table(spark, sf_dir).count(),)], "n_live long")


@query(BYTES_OF_OPS := OPS_SQL + "SELECT sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS logical, sum(17 + strlen(key) + coalesce(strlen(value), 0))::BIGINT AS log FROM ops")
def table_stats(spark, sf_dir):
    """Bytes as each commit counted them on their way to its run."""
    stats = log_table(spark, sf_dir).stats()
    return spark.createDataFrame([(stats["logical"], stats["log"])], "logical long, log long")


@query("SELECT i::INTEGER AS version, i::INTEGER AS n_runs FROM range(1, 9) t(i)")
def table_versions(spark, sf_dir):
    folder = log_table(spark, sf_dir).folder
    return spark.createDataFrame([(v, len(load(folder, v).runs)) for v in versions(folder)], "version int, n_runs int")


@query("SELECT 'table' AS name, 8 AS version, 8 AS n_runs, false AS closed_reads")
def table_handle(spark, sf_dir):
    table = log_table(spark, sf_dir)
    facts = (table.path.rpartition("/")[2], table.version, len(table.runs))
    table.close()
    table.close()
    try:
        table.view()
        reads = True
    except StoreError:
        reads = False
    return spark.createDataFrame([(*facts, reads)], "name string, version int, n_runs int, closed_reads boolean")


@query(
    """SELECT * FROM (VALUES ('get of a missing key', 'KeyNotFound'), ('get after close', 'StoreClosed'), ('set after close', 'StoreClosed'),
('second writer of a version', 'CommitConflict'), ('altered manifest', 'CorruptTable'), ('truncated snapshot', 'CorruptTable'),
('delete of a missing key', 'none'), ('empty batch', 'none')) t(operation, error)"""
)
def table_errors(spark, sf_dir):
    """What each operation raises."""
    top = shared_folder(spark)
    table, other = Table(spark, f"{top}/table"), Table(spark, f"{top}/table")
    closed = Table(spark, f"{top}/table")
    closed.close()
    table.set("a", "1")

    def altered():
        broken = Table(spark, f"{top}/broken")
        broken.set("a", "1")
        raw = broken.folder.read("manifest-1.json")
        broken.folder.put_if_absent("manifest-2.json", raw.replace(b'rows', b'rovs'))
        broken.refresh()

    def truncated():
        interop.export_snapshot(table.view(), f"{top}/whole")
        raw = b"".join(table.folder.__class__(spark, f"{top}/whole").chunks())
        table.folder.__class__(spark, f"{top}/cut").stream([raw[:-20]])
        interop.read_snapshot(spark, f"{top}/cut")

    found = []
    for name, work in (
        ("get of a missing key", lambda: table.get("b")), ("get after close", lambda: closed.get("a")), ("set after close", lambda: closed.set("a", "2")),
        ("second writer of a version", lambda: other.set("a", "2")), ("altered manifest", altered), ("truncated snapshot", truncated),
        ("delete of a missing key", lambda: table.delete("b")), ("empty batch", lambda: table.set_batch([])),
    ):
        try:
            work()
            found.append((name, "none"))
        except StoreError as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "operation string, error string")


@query(
    """SELECT unnest(['version_ties', 'null_keys', 'bad_ops', 'sets_without_value', 'deletes_with_value', 'repeated_keys', 'below_bound',
'above_bound', 'row_count', 'unsorted_keys', 'overlapping_files']) AS check_name, 0::BIGINT AS violations"""
)
def table_invariants(spark, sf_dir):
    return spark.createDataFrame(sorted(log_table(spark, sf_dir, "tiered").check().items()), "check_name string, violations long")


@query(L0_SQL + "SELECT * FROM stats")
def run_stats(spark, sf_dir):
    """Of the runs that the commits have left, as the manifest has them; a commit's sequence number is its run."""
    metadata = log_table(spark, sf_dir).run_metadata()
    return text(metadata.select(F.col("seq").cast("int").alias("run"), "min_key", "max_key", "n_rows", "n_tombstones"), "min_key", "max_key")


@query(L0_SQL + "SELECT run, min_key, max_key FROM stats WHERE 'user000149' BETWEEN min_key AND max_key")
def prune_runs_minmax(spark, sf_dir):
    table = log_table(spark, sf_dir)
    met = [(r.max_seq, r.min_key.decode(), r.max_key.decode()) for r in compaction.prune(list(table.runs), key=b"user000149")]
    return spark.createDataFrame(met, "run int, min_key string, max_key string")


@query(OPS_SQL + "SELECT 0 AS level, count(DISTINCT run)::BIGINT AS n_runs FROM ops HAVING count(DISTINCT run) >= 4")
def compaction_policy(spark, sf_dir):
    """The level that is due for a merge, of a table that has not merged yet."""
    runs = list(log_table(spark, sf_dir).runs)
    level = compaction.due(runs)
    return spark.createDataFrame([] if level is None else [(level, sum(r.level == level for r in runs))], "level int, n_runs long")


@query(OPS_SQL + "SELECT name, (SELECT count(*) FROM visible)::BIGINT AS n_live FROM (VALUES ('run-of-a-crash'), ('manifest-99.json.x.tmp')) t(name)")
def orphan_files(spark, sf_dir):
    """What a sweep of a table's folder deletes, and the keys that are live after it."""
    table = fresh_table(spark, sf_dir, "snapshot")
    table.operations().write.parquet(f"{table.path}/run-of-a-crash")
    table.folder.put_if_absent("manifest-99.json.x.tmp", b"part")
    gone = table.vacuum(keep_versions=RUNS, older_than_s=-1)
    live = Table(spark, table.path).count()
    return spark.createDataFrame([(name, live) for name in gone], "name string, n_live long")


@query(VISIBLE_SQL)
def stream_ingest(spark, sf_dir):
    """The log as a stream of micro-batches into a table."""
    top = shared_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    dead = F.col("event_type") == "error"
    ops = stream.select(
        F.when(dead, F.lit(DELETE)).otherwise(F.lit(SET)).alias("op"),
        F.format_string("user%06d", "user_id").alias("key"),
        F.when(~dead, F.concat("event_type", F.lit(":"), "props")).alias("value"),
        F.col("event_id").cast("int").alias("ord"),
    )
    table = Table(spark, f"{top}/table")
    ingest.start(ops, table, f"q{top[-8:]}", f"{top}/progress", available_now=True).awaitTermination()
    return text(Table(spark, table.path).view())


# -- other forms on disk


@query(VISIBLE_SQL)
def log_replay(spark, sf_dir):
    """The log as framed binary records in segments, and back."""
    path = f"{shared_folder(spark)}/log"
    interop.write_segments(log(spark, sf_dir), path)
    return text(lww.visible(interop.read_log(spark, path)))


@query(
    OPS_SQL
    + """SELECT key, value FROM (SELECT * FROM ops WHERE seq < 3 * (SELECT count(*) FROM events) // 4 - 1
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT dead"""
)
def log_segments_replay(spark, sf_dir):
    """Three stretches of segments, of which the second ends in a torn record: what follows it is not replayed."""
    top, ops = f"{shared_folder(spark)}/log", log(spark, sf_dir)
    half, end = middle(spark, sf_dir), middle(spark, sf_dir, 0.75)
    for name, part in (("a", ops.where(F.col("seq") < half)), ("b", ops.where((F.col("seq") >= half) & (F.col("seq") < end))), ("c", ops.where(F.col("seq") >= end))):
        written = interop.write_segments(part, top, f"{name}-")
        if name == "b" and written:
            whole = Folder(spark, written[-1])
            Folder(spark, f"{whole.root}-torn").join([(whole.root, whole.size("") - 5)])
            whole.delete("")
    return text(lww.visible(interop.read_log(spark, top)))


@query(VISIBLE_SQL)
def snapshot_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark)}/snapshot"
    interop.write_snapshot(lww.visible(log(spark, sf_dir)), path)
    return text(interop.read_snapshot(spark, path))


@query(VISIBLE_SQL)
def snapshot_file_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark)}/snapshot"
    interop.export_snapshot(lww.visible(log(spark, sf_dir)), path)
    return text(interop.read_snapshot(spark, path))


# -- command line


def shell(spark: SparkSession, *arguments: str) -> tuple[int, bytes]:
    """Exit code and standard output of a command."""
    out, quiet = io.TextIOWrapper(io.BytesIO()), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(quiet):
        code = cli.main(list(arguments), spark)
        sys.stdout.flush()
    return code, out.buffer.getvalue()


@query(VISIBLE_SQL + " WHERE key >= 'user000010' AND key < 'user000050'")
def cli_scan(spark, sf_dir):
    _, out = shell(spark, "--dir", log_table(spark, sf_dir).path, "scan", "user000010", "user000050")
    return spark.createDataFrame([tuple(x.decode().split("\t")) for x in out.splitlines()], "key string, value string")


@query(
    """SELECT * FROM (VALUES ('set k v', 0, ''), ('get k', 0, 'v'), ('delete k', 0, ''), ('get k after', 1, ''), ('compact', 0, 'compaction complete'),
('no command', 1, ''), ('unknown command', 1, '')) t(command, code, output)"""
)
def cli_commands(spark, sf_dir):
    at = ("--dir", f"{shared_folder(spark)}/table")
    done = []
    for name, words in (
        ("set k v", ("set", "k", "v")), ("get k", ("get", "k")), ("delete k", ("delete", "k")), ("get k after", ("get", "k")),
        ("compact", ("compact",)), ("no command", ()), ("unknown command", ("frobnicate",)),
    ):
        code, out = shell(spark, *at, *words)
        done.append((name, code, out.decode().strip()))
    return spark.createDataFrame(done, "command string, code int, output string")


@query("SELECT lower(md5('42:' || i)) AS random_key, printf('key%09d', i) AS sequential_key FROM range(1000) t(i)")
def workload_keys(spark, sf_dir):
    """The keys of the benchmark's two workloads: 16 seeded random bytes, and in sequence."""
    random = cli.random_keys(spark, 1000).select(F.lower(F.hex("key")).alias("random_key"))
    both = cli.sequential_keys(spark, 1000).withColumn("n", F.substring("key", 4, 9).cast("string").cast("long"))
    numbered = spark.range(1000).select(F.lower(F.md5(F.concat_ws(":", F.lit(42), "id"))).alias("random_key"), F.col("id").alias("n"))
    return random.join(numbered, "random_key").join(both, "n").select("random_key", F.col("key").cast("string").alias("sequential_key"))


# -- accounting


BYTES_SQL = OPS_SQL + """, bytes AS (SELECT *, strlen(key) AS k, coalesce(strlen(value), 0) AS v FROM ops)
"""


@query(BYTES_SQL + "SELECT count(*) AS n_ops, sum(k + v)::BIGINT AS logical_bytes, sum(17 + k + v)::BIGINT AS log_bytes FROM bytes")
def write_bytes(spark, sf_dir):
    return accounting.written(log(spark, sf_dir))


@query(
    BYTES_SQL
    + """, l0 AS (SELECT * FROM bytes QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1),
l1 AS (SELECT * FROM bytes QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
sums AS (SELECT (SELECT sum(17 + k + v)::BIGINT FROM bytes) AS log_bytes, (SELECT sum(k + v + 8)::BIGINT FROM l0) AS flush_bytes,
  (SELECT sum(k + v + 8)::BIGINT FROM l1) AS compact_bytes, (SELECT sum(k + v)::DOUBLE FROM bytes) AS logical)
SELECT log_bytes, flush_bytes, compact_bytes, (log_bytes + flush_bytes + compact_bytes)::DOUBLE / logical AS amplification FROM sums"""
)
def write_amplification(spark, sf_dir):
    ops = log(spark, sf_dir)
    flushed = lww.batch_last(ops.withColumn("run", run_of(spark, sf_dir)), "run").agg(F.sum(accounting.entry_bytes()).alias("flush_bytes"))
    merged = lww.latest(ops).agg(F.sum(accounting.entry_bytes()).alias("compact_bytes"))
    spent = accounting.written(ops)
    one = spent.join(F.broadcast(flushed)).join(F.broadcast(merged))  # a row each
    return one.select(
        "log_bytes",
        "flush_bytes",
        "compact_bytes",
        accounting.amplification(F.col("logical_bytes"), F.col("log_bytes"), F.col("flush_bytes"), F.col("compact_bytes")).alias("amplification"),
    )


@query(
    BYTES_SQL
    + """, l0 AS (SELECT * FROM bytes QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1)
SELECT run, sum(k + v + 8)::BIGINT AS held_bytes, count(*) AS n_entries FROM l0 GROUP BY run"""
)
def memtable_bytes(spark, sf_dir):
    held = lww.batch_last(log(spark, sf_dir).withColumn("run", run_of(spark, sf_dir)), "run")
    return held.groupBy("run").agg(F.sum(accounting.entry_bytes()).alias("held_bytes"), F.count(F.lit(1)).alias("n_entries"))


@query(
    """WITH v AS (SELECT list_sort(list(value)) AS l, count(value) AS n FROM events WHERE value IS NOT NULL)
SELECT l[floor(0.5 * (n - 1))::BIGINT + 1] AS p50, l[floor(0.95 * (n - 1))::BIGINT + 1] AS p95,
  l[floor(0.99 * (n - 1))::BIGINT + 1] AS p99 FROM v"""
)
def latency_percentiles(spark, sf_dir):
    return accounting.percentile_below(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", [0.5, 0.95, 0.99])


# -- forms and checks


@query(
    """WITH fine AS (SELECT event_id AS seq, printf('user%06d', user_id) || '/' || substr(props, 7) AS key,
  event_type = 'error' AS dead, event_type || ':' || props AS value FROM events)
SELECT lower(hex(key)) || chr(9) || lower(hex(value)) AS line FROM (
  SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT dead"""
)
def hex_export(spark, sf_dir):
    return hex_lines(lww.visible(log(spark, sf_dir, fine=True)))


CRC_SQL = """, crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT i::BIGINT AS i FROM range(256) r(i)))
"""


def crc_sql(bytes_list: str) -> str:
    """CRC-32 of a list of byte values, by table."""
    return f"xor(list_reduce({bytes_list}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def bytes_sql(column: str) -> str:
    """The byte values of an ASCII text."""
    return f"[ord(x)::BIGINT for x in string_split({column}, '') if x <> '']"


def fixed_sql(number: str) -> str:
    """A number as four byte values."""
    return f"[({number} >> 24) & 255, ({number} >> 16) & 255, ({number} >> 8) & 255, {number} & 255]"


@query(
    OPS_SQL
    + CRC_SQL
    + f""", parts AS (
  SELECT seq, CASE WHEN dead THEN 2 ELSE 1 END::BIGINT AS op, {bytes_sql("key")} AS k, {bytes_sql("coalesce(value, '')")} AS v FROM ops),
bodies AS (SELECT seq, [op] || {fixed_sql("len(k)")} || {fixed_sql("len(v)")} || k || v AS body FROM parts),
sums AS (SELECT seq, body, {crc_sql("body")} AS crc FROM bodies, crc_table)
SELECT seq, list_aggregate([printf('%02x', x) for x in {fixed_sql("len(body)")} || {fixed_sql("crc")} || body], 'string_agg', '') AS frame,
  true AS intact FROM sums"""
)
def crc_frame(spark, sf_dir):
    """Log records as bytes, and whether their checksum and lengths hold when read back."""
    frame = log(spark, sf_dir).select("seq", hashing.framed().alias("frame"))
    body = F.substring("frame", F.lit(9), F.octet_length("frame"))
    stored = F.conv(F.hex(F.substring("frame", 5, 4)), 16, 10).cast("long")
    size = F.conv(F.hex(F.substring("frame", 1, 4)), 16, 10).cast("long")
    return frame.select("seq", F.lower(F.hex("frame")).alias("frame"), ((F.crc32(body) == stored) & (F.octet_length(body) == size)).alias("intact"))


FNV_SQL = "list_reduce(b, lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261)"


@query(
    ASKED_SQL
    + CRC_SQL
    + f""", size AS (SELECT greatest(64, 10 * count(*)) AS bits FROM visible),
keys AS (SELECT key, true AS live FROM visible UNION ALL SELECT key, false FROM asked),
hashed AS (SELECT key, live, {FNV_SQL} AS h1, {crc_sql("b")} AS h2 FROM (SELECT *, {bytes_sql("key")} AS b FROM keys), crc_table),
places AS (SELECT key, live, unnest([h1 % bits, h2 % bits, xor(h1, ((h2::HUGEINT * 2654435761) & 4294967295)::BIGINT) % bits]) AS place FROM hashed, size)
SELECT p.key, bool_and(p.place IN (SELECT place FROM places WHERE live)) AS might_contain, any_value(v.key IS NOT NULL) AS present
FROM places p LEFT JOIN visible v ON p.key = v.key WHERE NOT live GROUP BY p.key"""
)
def bloom_might_contain(spark, sf_dir):
    """Asked keys against a filter over the live keys: bits set, whether all are, and whether the key is there.

    A filter is a set of places; a key's places are joined to it, so no filter is held as a whole."""
    live = lww.visible(log(spark, sf_dir)).select("key")
    bits = live.agg(hashing.filter_bits(F.count(F.lit(1))).alias("bits"))
    places = lambda df: df.join(F.broadcast(bits)).select("key", F.explode(F.array_distinct(hashing.probes(F.col("key"), F.col("bits")))).alias("place"))
    filled = places(live).select("place").distinct().withColumn("_set", F.lit(True))
    asked = places(asked_keys(spark)).join(filled, "place", "left").groupBy("key").agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("might_contain"))
    there = live.withColumn("_there", F.lit(True))
    return text(asked.join(there, "key", "left").select("key", "might_contain", F.coalesce("_there", F.lit(False)).alias("present")), "key")


@query(
    OPS_SQL
    + """SELECT 'version_ties' AS check_name, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM ops GROUP BY key, seq))::BIGINT AS violations
UNION ALL SELECT 'null_keys', count(*) FILTER (key IS NULL) FROM ops
UNION ALL SELECT 'bad_ops', 0
UNION ALL SELECT 'sets_without_value', count(*) FILTER (NOT dead AND value IS NULL) FROM ops
UNION ALL SELECT 'deletes_with_value', count(*) FILTER (dead AND value IS NOT NULL) FROM ops"""
)
def invariant_report(spark, sf_dir):
    return checks.report(log(spark, sf_dir))


# -- orders as a store


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.format_string("order%09d", "o_orderkey").cast("binary").alias("key"), F.col("o_orderpriority").cast("binary").alias("value")
    )


PAIRS_SQL = "WITH pairs AS (SELECT printf('order%09d', o_orderkey) AS key, o_orderpriority AS value FROM orders)\n"


@query(PAIRS_SQL + "SELECT key, value FROM pairs WHERE key >= 'order000001000' AND key < 'order000009000'")
def orders_kv_scan(spark, sf_dir):
    return text(read.scan(order_pairs(spark, sf_dir), "order000001000", "order000009000"))


@query(
    PAIRS_SQL
    + """, asked AS (SELECT DISTINCT printf('order%09d', l_orderkey * 2) AS key FROM lineitem)
SELECT a.key, p.value, p.key IS NOT NULL AS found FROM asked a LEFT JOIN pairs p ON a.key = p.key"""
)
def orders_multi_get(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    asked = lines.select(F.format_string("order%09d", F.col("l_orderkey") * 2).cast("binary").alias("key")).distinct()
    return text(read.multi_get(order_pairs(spark, sf_dir), asked))
