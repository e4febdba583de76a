"""Commits, crashes, compaction and conflicts of a table."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidelog import cli
from tidelog.operators import checks, merge
from tidelog.plans import compaction
from tidelog.plans.compaction import prune, tombstones_may_go
from tidelog.plans.manifest import Folder, Manifest, Run
from tidelog.schema import CommitConflict, CorruptTable, KeyNotFound, StoreClosed
from tidelog.sources import runs as run_files
from tidelog.streaming import ingest
from tidelog.table import Table


def state(t):
    return {bytes(r["key"]): bytes(r["value"]) for r in t.scan().collect()}


@pytest.mark.parametrize("mode", ["snapshot", "tiered"])
def test_model_through_commits_and_compactions(spark, tmp_path, mode):
    t, model, rng = Table(spark, str(tmp_path / "t"), mode), {}, random.Random(3)
    for i in range(6):
        batch = [(b"k%03d" % rng.randrange(40), b"v%d.%d" % (i, j)) for j in range(30)] + [(b"", b"empty"), (b"\xff\x00", b"")]
        t.set_batch(batch)
        model |= dict(batch)
        gone = rng.sample(sorted(model), 8)
        t.delete_batch(spark.createDataFrame([(bytearray(k),) for k in gone], "key binary"))
        for k in gone:
            del model[k]
    assert state(t) == model
    t.compact()
    again = Table(spark, str(tmp_path / "t"), mode)
    assert state(again) == model and again.count() == len(model)
    assert not any(again.check().values())
    assert again.write_amplification() > 1 and again.stats()["logical"] > 0
    if mode == "snapshot":
        assert len(again.runs) == 1 and again.runs[0].tombstones == 0
    keys = [bytes(r["key"]) for r in again.scan(b"k010", b"k020").collect()]
    assert keys == sorted(k for k in model if b"k010" <= k < b"k020")
    assert [bytes(r["key"]) for r in again.prefix_scan(b"k00").collect()] == sorted(k for k in model if k.startswith(b"k00"))


def test_deleted_key_stays_deleted_below_older_runs(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "tiered")
    for i in range(16):  # k sinks to the bottom level
        t.set_batch([("k" if i == 0 else "o", "old"), ("z", str(i))])
    assert any(r.level == 2 for r in t.runs)
    t.delete("k")
    for i in range(16):
        t.set("o", str(i))
        t.compact()
    with pytest.raises(KeyNotFound):
        t.get("k")


def test_values_of_any_size_and_all_tombstones(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "snapshot")
    t.set("big", b"x" * 100_000)
    t.compact()
    assert len(Table(spark, str(tmp_path / "t")).get("big")) == 100_000
    t.delete("big")
    t.delete("never")
    t.compact()
    assert t.runs == () and state(t) == {}
    t.set_batch([])
    assert t.version == 5  # an empty batch is no commit


def test_crash_before_the_manifest_is_invisible_and_swept(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.set("a", "1")
    t.operations().write.parquet(str(tmp_path / "t" / "run-staged"))
    (tmp_path / "t" / "manifest-9.json.x.tmp").write_text("part")
    again = Table(spark, str(tmp_path / "t"))
    assert state(again) == {b"a": b"1"}
    assert again.vacuum(older_than_s=3600) == []  # too young
    assert set(again.vacuum(older_than_s=-1)) == {"run-staged", "manifest-9.json.x.tmp"}
    assert state(again) == {b"a": b"1"}


def test_corrupt_manifest_fails_and_nothing_is_deleted(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.set("a", "1")
    path = tmp_path / "t" / "manifest-1.json"
    whole, before = path.read_text(), sorted(x.name for x in (tmp_path / "t").iterdir())
    for bad in ("", whole[: len(whole) // 2], whole.replace('\\"rows\\": 1', '\\"rows\\": 2')):
        path.write_text(bad)
        with pytest.raises(CorruptTable):
            Table(spark, str(tmp_path / "t"))
        with pytest.raises(CorruptTable):
            t.vacuum(older_than_s=-1)
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == before
    path.unlink()
    with pytest.raises(CorruptTable):
        Table(spark, str(tmp_path / "t"))
    body = json.loads(whole)
    body["body"] = body["body"].replace('"level": 0', '"level": 3')
    with pytest.raises(CorruptTable):
        Manifest.decoded(json.dumps(body).encode())


def test_conflicting_commit_fails_and_readers_keep_their_version(spark, tmp_path):
    a, b = Table(spark, str(tmp_path / "t")), Table(spark, str(tmp_path / "t"))
    a.set("k", "a")
    with pytest.raises(CommitConflict):
        b.set("k", "b")
    pinned = Table(spark, str(tmp_path / "t"))
    view = pinned.view()
    a.set("k", "later")
    a.compact()
    assert [bytes(r["value"]) for r in view.collect()] == [b"a"]
    pinned.refresh()
    assert pinned.get("k") == b"later"
    b.refresh()
    b.set("k", "b")
    assert b.get("k") == b"b"


def test_closed_handles(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.close()
    t.close()
    for f in (t.view, t.compact, lambda: t.get("a"), lambda: t.set("a", "b"), t.stats, t.refresh):
        with pytest.raises(StoreClosed):
            f()


def test_streamed_batches_are_applied_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "1"), (1, "b", "2")], "op int, key string, value string").write.parquet(source)
    stream = spark.readStream.schema("op int, key string, value string").parquet(source)
    ingest.start(stream, t, "q", str(tmp_path / "c"), available_now=True).awaitTermination()
    assert state(t) == {b"a": b"1", b"b": b"2"}
    version = t.version
    t.apply(spark.createDataFrame([(1, "a", "again")], "op int, key string, value string"), ("q", 0))
    assert t.version == version and t.get("a") == b"1"


def test_pruning_and_tombstone_rule():
    run = lambda p, level, lo, hi, a, b: Run(p, level, lo, hi, a, b, 1, 0, 1)
    old, new, far = run("old", 2, 0, 3, b"a", b"m"), run("new", 0, 5, 6, b"c", b"d"), run("far", 2, 0, 3, b"x", b"z")
    assert not tombstones_may_go([new], [old, new])
    assert tombstones_may_go([new], [far, new])
    assert tombstones_may_go([new, old], [old, new])
    assert tombstones_may_go([old], [old, new])
    assert [r.path for r in prune([old, far], key=b"b")] == ["old"]
    assert [r.path for r in prune([old, far], b"m", b"x")] == ["old"]
    assert [r.path for r in prune([old, far], b"n")] == ["far"]


def test_command_line(spark, tmp_path, capfdbinary):
    run = lambda *a: cli.main(["--dir", str(tmp_path / "t"), *a], spark)
    assert run("set", "k", "v") == 0 and run("set", "l", "w") == 0 and run("get", "k") == 0
    assert capfdbinary.readouterr().out.endswith(b"v")
    assert run("scan", "a", "z") == 0
    assert capfdbinary.readouterr().out == b"k\tv\nl\tw\n"
    assert run("delete", "k") == 0 and run("get", "k") == 1 and run("compact") == 0 and run("bench", "--ops", "100") == 0
    assert b"compaction complete" in capfdbinary.readouterr().out
    assert Folder(spark, str(tmp_path / "t")).size("") > 0


def test_bottom_level_is_merged_and_tombstones_end_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "FANOUT", {0: 2, 1: 2, 2: 2})
    t, model = Table(spark, str(tmp_path / "t"), "tiered"), {}
    for i in range(16):
        t.set_batch([(b"k%d" % (i % 5), b"v%d" % i), (b"x%d" % i, b"")])
        model |= {b"k%d" % (i % 5): b"v%d" % i, b"x%d" % i: b""}
        if i % 4 == 3:
            t.delete(b"x%d" % i)
            del model[b"x%d" % i]
    assert state(t) == model and not any(t.check().values())
    assert sum(r.level == 2 for r in t.runs) <= 1
    t.compact()
    bottom = [r for r in t.runs if r.level == 2]
    assert len(bottom) == 1 and bottom[0].tombstones == 0


def test_multi_get_of_any_number_of_keys(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t"), "snapshot")
    t.set_batch([(b"k%03d" % i, b"a") for i in range(0, 200, 2)])
    t.set_batch([(b"k%03d" % i, b"b") for i in range(0, 50)])
    t.delete("k004")
    model = state(t)
    for asked in ([], [b"k002"], [b"k001", b"k004", b"k199", b"k002", b"k002", b"zzz", b""], [b"k%03d" % i for i in range(0, 200, 3)], [None, b"k000"], [None]):
        keys = spark.createDataFrame([(None if k is None else bytearray(k), i) for i, k in enumerate(asked)], "key binary, place int")
        for most in (32 << 20, 0):
            monkeypatch.setattr("tidelog.table.ASKED_BYTES", most)
            got = {r["place"]: (None if r["value"] is None else bytes(r["value"]), r["found"]) for r in t.multi_get(keys).collect()}
            assert got == {i: (model.get(k), k in model) for i, k in enumerate(asked)}


def test_a_batch_is_computed_once_and_written_in_one_shuffle(spark, tmp_path):
    t, seen = Table(spark, str(tmp_path / "t"), "snapshot"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000, numPartitions=4).select(F.format_string("k%05d", "id").cast("binary").alias("key"), F.lit(b"v").alias("value"))
    t.set_batch(rows.mapInArrow(counted, "key binary, value binary"))
    assert seen.value == 1000 and t.count() == 1000
    assert t.stats()["logical"] == 1000 * 7 and t.runs[0].rows == 1000
    plan = merge.merge([run_files.by_range(t.operations(), 3)], True).sortWithinPartitions("key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_files_out_of_order_are_told(spark, tmp_path):
    rows = lambda *ks: spark.createDataFrame([(bytearray(k),) for k in ks], "key binary").coalesce(1)
    count = lambda disjoint: {r["check_name"]: r["violations"] for r in checks.file_report(spark, str(tmp_path / "r"), disjoint).collect()}
    rows(b"a", b"c").write.parquet(str(tmp_path / "r"))
    rows(b"d", b"e").write.mode("append").parquet(str(tmp_path / "r"))
    assert count(True) == {"unsorted_keys": 0, "overlapping_files": 0}
    rows(b"b", b"b", b"a").write.mode("append").parquet(str(tmp_path / "r"))
    assert count(True) == {"unsorted_keys": 2, "overlapping_files": 1} and count(False)["overlapping_files"] == 0


def test_usage_and_workloads(spark, tmp_path, capfd):
    assert cli.main([], spark) == 1 and cli.main(["--dir", str(tmp_path), "frobnicate"], spark) == 1
    assert "usage" in capfd.readouterr().err
    keys = [bytes(r["key"]) for r in cli.random_keys(spark, 500).collect()]
    assert len(set(keys)) == 500 and {len(k) for k in keys} == {16}
    assert sorted(keys) == sorted(bytes(r["key"]) for r in cli.random_keys(spark, 500).repartition(3).collect())
    assert keys != [bytes(r["key"]) for r in cli.random_keys(spark, 500, seed=7).collect()]


def test_runs_of_several_batches_are_written_together(spark, tmp_path, monkeypatch):
    met, write = threading.Barrier(2), run_files.write

    def waits(*args):
        met.wait(timeout=60)  # fails if no other run is being written
        return write(*args)

    batch = lambda i: spark.createDataFrame([(bytearray(b"k%d" % (j % 7)), bytearray(b"v%d.%d" % (i, j)), j) for j in range(20)], "key binary, value binary, ord int").withColumn("op", F.lit(1))
    facts = lambda t: ([(r.min_seq, r.max_seq, r.level, r.rows, r.min_key, r.max_key) for r in t.runs], t.version, t.stats()["logical"], state(t))
    for mode in ("snapshot", "tiered"):
        for empty in ((), (0, 3)):
            batches = [batch(i).where(F.lit(i not in empty)) for i in range(6)]
            one, many = Table(spark, str(tmp_path / f"one-{mode}{len(empty)}"), mode), Table(spark, str(tmp_path / f"many-{mode}{len(empty)}"), mode)
            for b in batches:
                one.apply(b)
            if not empty and mode == "snapshot":
                with monkeypatch.context() as m:
                    m.setattr(run_files, "write", waits)
                    many.apply_all(batches)
            else:
                many.apply_all(batches)
            assert facts(many) == facts(one) and many.version >= 6 - len(empty)
            assert facts(Table(spark, many.path, mode)) == facts(one)


def test_a_bad_batch_among_several_publishes_those_before_it(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "snapshot")
    good = lambda k: spark.createDataFrame([(1, k, "v")], "op int, key string, value string")
    with pytest.raises(Exception, match="an operation needs a key"):
        t.apply_all([good("a"), spark.createDataFrame([(1, "b", None)], "op int, key string, value string"), good("c"), good("d")])
    assert state(t) == {b"a": b"v"} and state(Table(spark, t.path)) == {b"a": b"v"}
    assert len([n for n, _ in t.folder.names() if n.startswith("run-")]) <= 2  # the one that failed may be left to vacuum
    t.vacuum(older_than_s=-1)
    t.apply_all([good("c"), good("d")])
    assert [r.max_seq for r in t.runs] == [0, 1, 2] and sorted(state(t)) == [b"a", b"c", b"d"]
