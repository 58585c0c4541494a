"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hilbertine-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``, survives the loss of any
    executor, and stores columns compressed. What an application has written goes
    with ``clear`` or when its driver ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    path = f"{shared_dir(spark)}/hilbertine/{spark.sparkContext.applicationId}"
    if path not in _used:
        _used.add(path)
        atexit.register(clear, spark)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written here; no result that reads them may be used afterwards."""
    with contextlib.suppress(Exception):  # the application may have ended
        path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
