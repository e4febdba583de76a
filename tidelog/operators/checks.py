"""Structural checks of operations and runs, as counts of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DELETE, SET, key_lit


def report(ops: DataFrame) -> DataFrame:
    """(check_name, violations), one row a check; all zero in a sound log."""
    per_version = ops.groupBy("key", "seq", "ord").agg(F.count(F.lit(1)).alias("n"))
    ties = per_version.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v")).select(F.lit("version_ties").alias("check_name"), F.col("v").cast("long").alias("violations"))
    rows = ops.agg(
        F.count_if(F.col("key").isNull()).alias("null_keys"),
        F.count_if(~F.col("op").isin(SET, DELETE)).alias("bad_ops"),
        F.count_if((F.col("op") == SET) & F.col("value").isNull()).alias("sets_without_value"),
        F.count_if((F.col("op") == DELETE) & F.col("value").isNotNull()).alias("deletes_with_value"),
    )
    names = ("null_keys", "bad_ops", "sets_without_value", "deletes_with_value")
    flat = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in names))).alias("x")).select("x.*")
    return flat.unionByName(ties)


def run_report(run: DataFrame, lower: bytes | None, upper: bytes | None, rows: int) -> DataFrame:
    """(check_name, violations) for one run: a version for each key, bounds and row count as recorded."""
    found = run.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("key").alias("keys"),
        F.count_if(F.col("key") < key_lit(lower or b"")).alias("below"),
        F.count_if(F.col("key") > key_lit(upper or b"")).alias("above") if upper is not None else F.count(F.lit(1)).alias("above"),
    )
    checks = {"repeated_keys": F.col("n") - F.col("keys"), "below_bound": F.col("below"), "above_bound": F.col("above"), "row_count": F.abs(F.col("n") - rows)}
    return found.select(
        F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), v.cast("long").alias("violations")) for k, v in checks.items()))).alias("x")
    ).select("x.*")


def file_report(spark: SparkSession, path: str, disjoint: bool) -> DataFrame:
    """(check_name, violations) over the files of one run: keys that don't rise inside their file and, if files are
    to be ``disjoint``, files that begin before another's end. A window holds one file's keys, or one row a file."""
    place = Window.partitionBy("file").orderBy("at")
    rows = spark.read.parquet(path).select("key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    fallen = rows.withColumn("_before", F.lag("key").over(place)).where(F.col("_before") >= F.col("key"))
    bounds = rows.groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    met = bounds.withColumn("_before", F.lag("hi").over(Window.orderBy("lo"))).where((F.col("_before") >= F.col("lo")) & F.lit(disjoint))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    return count(fallen, "unsorted_keys").unionByName(count(met, "overlapping_files"))
