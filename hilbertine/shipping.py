"""Sending this package to the executors, whose Python need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once; Spark hands them to every executor."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp()) / "hilbertine.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)


def shipped(f: Callable) -> Callable:
    """``f`` (whose first argument is the session), run after the package has been sent."""

    @wraps(f)
    def run(spark: SparkSession, *args, **more):
        ship(spark)
        return f(spark, *args, **more)

    return run
