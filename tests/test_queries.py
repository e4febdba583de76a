"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os
import threading

import duckdb
import pytest

from tidelog import queries
from tidelog.sources import runs as run_files

SF = "/root/testdata/sf0.001"


def rows_of(rows):
    plain = lambda v: bytes(v) if isinstance(v, (bytearray, memoryview)) else round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = df.collect()
    want = duck.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    assert rows_of([r[c] for c in order] for r in got) == rows_of([r[i] for i in at] for r in want.fetchall())
    if name == "bloom_might_contain":
        assert all(r["might_contain"] for r in got if r["present"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["log_replay", "log_segments_replay"])
def test_no_log_comes_to_the_driver(spark, duck, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("a log came to the driver")

    for there in ("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", "tidelog.plans.manifest.Folder.stream", "tidelog.plans.manifest.Folder.chunks"):
        monkeypatch.setattr(there, refuse)
    monkeypatch.setattr("tidelog.sources.interop.SEGMENT_BYTES", 4000, raising=False)  # many segments in each stretch
    got = queries.queries()[name](spark, SF).select("key", "value").collect()
    assert rows_of(got) == rows_of(duck.sql(f"SELECT key, value FROM ({queries.oracle_sql()[name]})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_commits_of_a_table_are_written_together(spark, monkeypatch):
    met, write = threading.Barrier(2), run_files.write

    def waits(*args):
        met.wait(timeout=60)  # fails if no other run is being written
        return write(*args)

    monkeypatch.setattr(run_files, "write", waits)
    table = queries.fresh_table(spark, SF, "snapshot")
    assert [r.max_seq for r in table.runs] == list(range(queries.RUNS)) and table.version == queries.RUNS
