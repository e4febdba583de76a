"""Command line: python -m tidelog.cli --dir DIR {set,get,delete,scan,compact,bench} ..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import KeyNotFound, StoreError
from .table import MODES, Table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("--dir", default="./tidelog-data")
    p.add_argument("--mode", choices=MODES, default="snapshot")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in (("set", ("key", "value")), ("get", ("key",)), ("delete", ("key",)), ("scan", ("start", "end")), ("compact", ())):
        sub = verbs.add_parser(verb)
        for n in names:
            sub.add_argument(n)
    verbs.add_parser("bench").add_argument("--ops", type=int, default=100_000)
    return p


def sequential_keys(spark: SparkSession, n: int) -> DataFrame:
    """(key) key000000000 and up."""
    return spark.range(n).select(F.format_string("key%09d", "id").cast("binary").alias("key"))


def random_keys(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(key) of 16 bytes, the same for a seed at any number of partitions: they are a hash of the seed and the place."""
    return spark.range(n).select(F.unhex(F.md5(F.concat_ws(":", F.lit(seed), "id"))).alias("key"))


def bench(spark: SparkSession, table: Table, ops: int) -> dict[str, float]:
    """Operations a second: batches of sequential and of random keys, a join of as many random keys of either kind, and
    a reopening with a count."""
    out = {}

    def timed(name, work):
        began = time.perf_counter()
        work()
        out[name] = ops / (time.perf_counter() - began)

    value = F.lit("benchmark-value-data")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    timed("write sequential", lambda: table.set_batch(sequential_keys(spark, ops).withColumn("value", value)))
    timed("write random", lambda: table.set_batch(random_keys(spark, ops).withColumn("value", value)))
    place = F.pmod(F.xxhash64("id", F.lit(42)), F.lit(ops))
    asked = spark.range(ops).select(F.format_string("key%09d", place).cast("binary").alias("key"))
    timed("read sequential", lambda: noop(table.multi_get(asked)))
    timed("read random", lambda: noop(table.multi_get(random_keys(spark, ops))))
    timed("reopen", lambda: Table(spark, table.path, table.mode).count())
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:  # usage was printed
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("tidelog").getOrCreate()
    try:
        with Table(spark, args.dir, args.mode) as table:
            if args.verb == "set":
                table.set(args.key, args.value)
            elif args.verb == "get":
                sys.stdout.buffer.write(table.get(args.key))
                sys.stdout.buffer.flush()
            elif args.verb == "delete":
                table.delete(args.key)
            elif args.verb == "scan":
                for row in table.scan(args.start, args.end).toLocalIterator():
                    sys.stdout.buffer.write(bytes(row["key"]) + b"\t" + bytes(row["value"]) + b"\n")
                sys.stdout.buffer.flush()
            elif args.verb == "compact":
                table.compact()
                print("compaction complete")
            else:
                for name, rate in bench(spark, table, args.ops).items():
                    print(f"{name}: {rate:,.0f} ops/s")
    except KeyNotFound:
        print("key not found", file=sys.stderr)
        return 1
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
