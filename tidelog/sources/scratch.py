"""Folders for what a job needs for a while and all executors read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..schema import StoreError


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared folder that spark.checkpoint.dir names; the session deletes it when it ends.

    Only on one machine may that be unset: a temporary folder is used then. On a cluster it would be another one on
    each executor, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir")
    if top is None:
        if not conf.get("spark.master", "").startswith("local"):
            raise StoreError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}"
    path = f"{top}/tidelog-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path
