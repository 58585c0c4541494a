"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleared: set[str] = set()


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


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back; it goes when the application's driver ends.

    This cuts the lineage, survives lost executors, and keeps plans short: a cache upon a cache has the plans of both in its own.
    """
    spark = df.sparkSession
    folder = _folder(spark)
    if folder not in _cleared:
        _cleared.add(folder)
        atexit.register(clear_written, spark)
    path, schema = f"{folder}/{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/hilbertine-tables/{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> None:
    """Delete what ``written`` has left; no result that reads it may be used afterwards. To be called before a session is stopped by hand."""
    with contextlib.suppress(Exception):  # the application may have ended
        path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
