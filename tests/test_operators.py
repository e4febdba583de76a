"""Views, reads and merges against a plain dictionary."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tidelog.functions import accounting, hashing
from tidelog.operators import checks, lww, merge, read
from tidelog.schema import DELETE, OPS, SET, CommitConflict, CorruptTable, canonical
from tidelog.sources import interop


def ops_of(spark, rows):
    return spark.createDataFrame([(s, o, op, bytearray(k), None if v is None else bytearray(v)) for s, o, op, k, v in rows], OPS)


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def random_log(seed, n=3000, keys=150):
    rng = random.Random(seed)
    rows, model = [], {}
    for i in range(n):
        k = rng.choice([b"", b"\xff" * 4, b"\x00\x01\xfe", b"a\tb", b"a\nb"] + [b"k%04d" % rng.randrange(keys)] * 20)
        if rng.random() < 1 / 3:
            rows.append((i // 10, i % 10, DELETE, k, None))
            model.pop(k, None)
        else:
            v = rng.choice([b"", b"v%d" % i])
            rows.append((i // 10, i % 10, SET, k, v))
            model[k] = v
    return rows, model


@pytest.mark.parametrize("seed", [1, 42])
def test_visible_equals_model_and_scans_equal_ranges(spark, seed):
    rows, model = random_log(seed)
    ops = ops_of(spark, rows).cache()
    view = lww.visible(ops)
    assert pairs(read.scan(view)) == sorted(model.items())
    for a, b in [(b"k0010", b"k0050"), (b"k0050", b"k0010"), (b"k0040", b""), (b"k0040", b"k0040"), (b"\xff", b""), (b"", b"k")]:
        want = sorted((k, v) for k, v in model.items() if k >= a and (not b or k < b))
        assert pairs(read.scan(view, a, b)) == want
    assert read.count(view).first()["n_live"] == len(model)
    assert {r["check_name"]: r["violations"] for r in checks.report(ops).collect()} == dict.fromkeys(
        ["version_ties", "null_keys", "bad_ops", "sets_without_value", "deletes_with_value"], 0
    )
    # a base and an overlapping log, and merges of parts, give the same state
    base = merge.merge([lww.as_of(ops, 150)], drop_tombstones=True)
    assert sorted(pairs(lww.visible(merge.recover(base, ops.where("seq > 70"))))) == sorted(model.items())
    parts = [lww.latest(ops.where(F.col("seq") % 3 == i)) for i in range(3)]
    assert sorted(pairs(lww.visible(merge.merge([parts[0], merge.merge(parts[1:], False)], False)))) == sorted(model.items())


def test_all_tombstones_merge_to_nothing(spark):
    ops = ops_of(spark, [(0, 0, DELETE, b"a", None), (1, 0, DELETE, b"", None)])
    assert merge.merge([ops], drop_tombstones=True).count() == 0
    assert lww.deleted(ops).count() == 2


def test_multi_get_tells_empty_from_missing(spark):
    view = lww.visible(ops_of(spark, [(0, 0, SET, b"e", b""), (0, 1, SET, b"x", b"1")]))
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"e", b"m", b"x")], "key binary")
    got = {bytes(r["key"]): (r["value"] and bytes(r["value"]), r["found"]) for r in read.multi_get(view, keys).collect()}
    assert got[b"m"] == (None, False) and got[b"x"] == (b"1", True) and got[b"e"][1]
    assert [bytes(r[0]) for r in read.missing(view, keys).collect()] == [b"m"]
    assert read.successor(b"a\xff\xff") == b"b" and read.successor(b"\xff") == b""


def test_bad_operations_fail_loudly(spark):
    for row in [(0, 0, 3, b"k", b"v"), (0, 0, SET, b"k", None), (0, 0, DELETE, b"k", b"v")]:
        with pytest.raises(Exception, match="an operation needs"):
            canonical(ops_of(spark, [row])).collect()


def test_delete_hits(spark):
    ops = ops_of(spark, [(0, 0, DELETE, b"k", None), (1, 0, SET, b"k", b"v"), (2, 0, DELETE, b"k", None), (3, 0, DELETE, b"k", None)])
    assert [r["hit"] for r in lww.delete_hits(ops).orderBy("seq").collect()] == [False, True, False]


def test_log_prefix(spark):
    ops = ops_of(spark, [(i, 0, SET, b"k%d" % i, b"v") for i in range(10)])
    assert merge.valid_prefix(ops, F.col("seq") != 4).count() == 4
    assert merge.valid_prefix(ops, F.lit(True)).count() == 10
    r = merge.dropped_report(ops, ~F.col("seq").isin(4, 7)).first()
    assert (r["cut_at"], r["n_kept"], r["n_dropped"]) == (4, 4, 6)


def record(op, key, value):
    body = struct.pack(">BII", op, len(key), len(value)) + key + value
    return struct.pack(">II", len(body), zlib.crc32(body)) + body


def test_frames_and_binary_logs(spark, tmp_path):
    entries = [(SET, b"foo", b"1"), (SET, b"", b""), (DELETE, b"foo", b"")]
    raw = b"".join(record(*e) for e in entries)
    ops = ops_of(spark, [(i, 0, op, k, v if op == SET else None) for i, (op, k, v) in enumerate(entries)])
    assert b"".join(bytes(r[0]) for r in ops.orderBy("seq").select(hashing.framed()).collect()) == raw
    flipped = bytearray(raw)
    flipped[len(record(*entries[0])) + 9] ^= 1
    for name, body, n in [("whole", raw, 3), ("torn", raw[:-2], 2), ("flip", bytes(flipped), 1), ("empty", b"", 0), ("zero", b"\0" * 8, 0)]:
        (tmp_path / name).write_bytes(body)
        assert interop.read_log(spark, str(tmp_path / name)).count() == n, name


def test_segments_of_a_log_have_one_order(spark, tmp_path):
    frame = lambda ops: b"".join(bytes(r["f"]) for r in ops_of(spark, ops).orderBy("seq").select(hashing.framed().alias("f")).collect())
    first = frame([(0, 0, SET, b"a", b"1"), (1, 0, SET, b"b", b"1")])
    second = frame([(2, 0, DELETE, b"a", None), (3, 0, SET, b"b", b"2")])
    third = frame([(4, 0, SET, b"c", b"3")])
    for name, raw in (("log-1", first), ("log-2", second), ("log-3", third)):
        (tmp_path / name).write_bytes(raw)
    read_all = lambda: sorted(pairs(lww.visible(interop.read_log(spark, str(tmp_path)))))
    assert read_all() == [(b"b", b"2"), (b"c", b"3")]
    (tmp_path / "log-2").write_bytes(second[:-1])  # the log ends there: neither b's second value nor c
    assert read_all() == [(b"b", b"1")]
    (tmp_path / "log-1").write_bytes(b"")
    assert read_all() == []
    interop.write_log(ops_of(spark, [(0, 0, SET, b"a", b"1"), (1, 0, SET, b"b", b"1")]), str(tmp_path / "own"))
    assert (tmp_path / "own").read_bytes() == first


def forbid_driver(monkeypatch):
    """No rows of a table come to the driver's Python, but one of totals, and no file's bytes."""
    collect = DataFrame.collect

    def refuse(*_, **__):
        raise AssertionError("rows came to the driver")

    def one(df):
        assert len(rows := collect(df)) < 2
        return rows

    monkeypatch.setattr(DataFrame, "collect", one)
    for name in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, refuse)
    monkeypatch.setattr("tidelog.plans.manifest.Folder.stream", refuse)
    monkeypatch.setattr("tidelog.plans.manifest.Folder.chunks", refuse)


def awkward_log(n=2000):
    """Operations whose records have newlines anywhere, at their ends too, or nowhere, in falling order."""
    rng, rows = random.Random(5), []
    for i in range(n):
        key = rng.choice([b"", b"\n", b"k%d\n" % (i % 90), b"k%010d" % (i % 90), b"\xff\x00"])
        rows.append((i // 10, i % 10, DELETE, key, None) if i % 7 == 0 else (i // 10, i % 10, SET, key, rng.choice([b"", b"\n", b"\n\n", b"v%d" % i, b"\xff\n\x80" * 9, b"x" * 5000])))
    return rows


def test_executors_write_a_log(spark, tmp_path, monkeypatch):
    rows = awkward_log()
    raw = b"".join(record(op, k, v or b"") for _, _, op, k, v in rows)
    ops = ops_of(spark, rows[::-1]).repartition(3)
    want = sorted(pairs(lww.visible(ops)))
    monkeypatch.setattr(interop, "SEGMENT_BYTES", len(raw) // 5, raising=False)
    with monkeypatch.context() as m:
        forbid_driver(m)
        interop.write_log(ops, str(tmp_path / "one"))
        names = interop.write_segments(ops, str(tmp_path / "log"), "s-")
        assert interop.write_segments(ops.where("false"), str(tmp_path / "none")) == []
        interop.write_log(ops.where("false"), str(tmp_path / "empty"))
    assert (tmp_path / "one").read_bytes() == raw and (tmp_path / "empty").read_bytes() == b""
    files = sorted(p for p in (tmp_path / "log").iterdir() if not p.name.startswith("."))
    assert len(files) > 2 and [p.name for p in files] == [n.rpartition("/")[2] for n in names]
    assert b"".join(p.read_bytes() for p in files) == raw
    for path in ("one", "log"):
        assert sorted(pairs(lww.visible(interop.read_log(spark, str(tmp_path / path))))) == want, path
    assert interop.read_log(spark, str(tmp_path / "none")).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["empty", "log", "none", "one"]  # nothing temporary is left
    with pytest.raises(CommitConflict):
        interop.write_log(ops, str(tmp_path / "one"))


def test_executors_write_a_snapshot_file(spark, tmp_path, monkeypatch):
    want = [(b"k%05d" % i, b"v%d\n" % i) for i in range(1000)]
    view = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in want[::-1]], "key binary, value binary").repartition(3)
    with monkeypatch.context() as m:
        forbid_driver(m)
        interop.export_snapshot(view, str(tmp_path / "one"))
    body = b"SNAPSHOT v2\n" + b"".join(k.hex().encode() + b"\t" + v.hex().encode() + b"\n" for k, v in want)
    assert (tmp_path / "one").read_bytes() == body + b"CHECKSUM %d\n" % zlib.crc32(body)
    assert sorted(pairs(interop.read_snapshot(spark, str(tmp_path / "one")))) == want


def test_snapshot_text(spark, tmp_path):
    want = [(b"", b"x"), (b"\t\n", b""), (b"k", b"\xff" * 100_000)]
    view = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in want], "key binary, value binary")
    whole = tmp_path / "s"
    interop.write_snapshot(view, str(whole))
    assert sorted(pairs(interop.read_snapshot(spark, str(whole)))) == want
    interop.write_snapshot(view.where("false"), str(tmp_path / "none"))
    assert pairs(interop.read_snapshot(spark, str(tmp_path / "none"))) == []

    def fails(path, why):
        with pytest.raises(CorruptTable, match=why):
            interop.read_snapshot(spark, str(path)).collect()

    part = next(p for p in sorted(whole.glob("part-*")) if p.stat().st_size > 10)
    body, crc = part.read_bytes(), part.with_name(f".{part.name}.crc")
    crc.unlink(missing_ok=True)
    part.write_bytes(body[: len(body) // 2])
    fails(whole, "checksum")
    part.write_bytes(body.replace(b"6b\tff", b"6b\tfe") if b"6b\tff" in body else b"00" + body)
    fails(whole, "checksum")
    (whole / "_SNAPSHOT").unlink()
    fails(whole, "unfinished")

    one = tmp_path / "one"
    interop.export_snapshot(view, str(one))
    raw = one.read_bytes()
    assert raw == b"".join([b"SNAPSHOT v2\n", *(k.hex().encode() + b"\t" + v.hex().encode() + b"\n" for k, v in want)]) + raw[raw.rindex(b"CHECKSUM") :]
    assert int(raw[raw.rindex(b" ") :]) == zlib.crc32(raw[: raw.rindex(b"CHECKSUM")])
    assert sorted(pairs(interop.read_snapshot(spark, str(one)))) == want
    for name, bad, why in (
        ("cut", raw[: raw.rindex(b"CHECKSUM")], "truncated"), ("half", raw[: len(raw) // 2], "truncated"), ("empty", b"", "header"),
        ("altered", raw.replace(b"ffff", b"fffe", 1), "checksum"), ("other", raw.replace(b"v2", b"v9"), "header"),
    ):
        (tmp_path / name).write_bytes(bad)
        fails(tmp_path / name, why)


def fnv(b):
    h = 2166136261
    for x in b:
        h = (h ^ x) * 16777619 & 0xFFFFFFFF
    return h


def test_probes_equal_plain_python(spark):
    keys = [b"foo", b"bar", b"baz", b"", b"\xff\x00z"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    for r in df.select("key", hashing.probes(F.col("key"), F.lit(1000)).alias("p")).collect():
        k = bytes(r["key"])
        a, b = fnv(k), zlib.crc32(k)
        assert list(r["p"]) == [x % 1000 for x in (a, b, a ^ (b * 0x9E3779B1 & 0xFFFFFFFF))]


def test_accounting(spark):
    ops = ops_of(spark, [(0, 0, SET, b"ab", b"cde"), (1, 0, DELETE, b"ab", None)])
    r = accounting.written(ops).first()
    assert (r["n_ops"], r["logical_bytes"], r["log_bytes"]) == (2, 7, 17 * 2 + 7)
    assert accounting.written(ops.where("false")).first()["log_bytes"] == 0
    zero = spark.range(1).select(accounting.amplification(F.lit(0), F.lit(1), F.lit(1), F.lit(1)).alias("x")).first()["x"]
    assert zero == 0.0
    xs = [5.0, 1.0, 1.0, 9.0, 7.0]
    got = accounting.percentile_below(spark.createDataFrame([(x,) for x in xs], "v double"), "v", [0.5, 0.95, 0.0]).first()
    assert list(got) == [sorted(xs)[int(p * 4)] for p in (0.5, 0.95, 0.0)]


def test_key_range_reaches_the_scan(spark, tmp_path):
    ops_of(spark, [(i, 0, SET, b"k%03d" % i, b"v") for i in range(50)]).write.parquet(str(tmp_path / "p"))
    plan = read.scan(lww.visible(spark.read.schema(OPS).parquet(str(tmp_path / "p"))), b"k010", b"k020")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in text and "LessThan(key" in text
