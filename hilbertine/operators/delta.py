"""A table whose rows change places a few at a time: a base that is left alone, and a small table of what has moved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import BROADCAST_ROWS

MOVES = "home long, slot long"
#: The base is written anew when one of so many rows has moved.
FOLD = 4


@dataclass(frozen=True)
class Places:
    """``base``: folder of the rows by the slots that they had (``home``); ``moves``: folder of (home, slot) for those elsewhere now, or none."""

    spark: SparkSession
    path: str
    n: int
    base: str
    moves: str | None
    moved: int
    version: int

    def read(self) -> DataFrame:
        """The rows with their present slots; the moves are merged in passing, by a broadcast where they are few."""
        base = self.spark.read.parquet(self.base)
        if self.moves is None:
            return base.withColumnRenamed("home", "slot")
        moves = self._moves()
        moves = F.broadcast(moves) if self.moved <= BROADCAST_ROWS else moves
        rows = base.join(moves, "home", "left")
        return rows.withColumn("slot", F.coalesce("slot", "home")).drop("home")

    def _moves(self) -> DataFrame:
        return self.spark.read.schema(MOVES).parquet(self.moves)


def begin(rows: DataFrame, path: str) -> Places:
    """Write the rows (slot, ...) as a base below ``path``."""
    base = f"{path}/base-0"
    rows.withColumnRenamed("slot", "home").write.mode("overwrite").parquet(base)
    spark = rows.sparkSession
    return Places(spark, path, spark.read.parquet(base).count(), base, None, 0, 0)


def apply(places: Places, perm: DataFrame) -> Places:
    """The rows moved by ``perm`` (new_slot, old_slot: a permutation; slots that it lacks stay).

    What is written is one number pair for each row that is away from its base, whatever the rows' width and number; rows
    that come home are forgotten. When a quarter of all rows is away, the base is written anew, and none is.
    Each version has folders of its own: readers of the one before are not disturbed, and a run that is lost is simply repeated.
    """
    spark, version = places.spark, places.version + 1
    changed = perm.filter("new_slot <> old_slot").select("new_slot", F.col("old_slot").alias("slot"))
    if places.moves is None:
        now = changed.select(F.col("slot").alias("home"), F.col("new_slot").alias("slot"))
    else:
        both = changed.join(places._moves(), "slot", "full")
        # a row that changes was away already or lies at home; one that doesn't change stays away
        now = both.select(F.coalesce("home", "slot").alias("home"), F.coalesce("new_slot", "slot").alias("slot"))
    folder = f"{places.path}/moves-{version}"
    now.filter("home <> slot").write.mode("overwrite").parquet(folder)
    moved = spark.read.schema(MOVES).parquet(folder).count()
    after = Places(spark, places.path, places.n, places.base, folder, moved, version)
    return fold(after) if FOLD * moved >= places.n else after


def fold(places: Places) -> Places:
    """The base written anew with all rows in their places."""
    base = f"{places.path}/base-{places.version}"
    places.read().withColumnRenamed("slot", "home").write.mode("overwrite").parquet(base)
    return Places(places.spark, places.path, places.n, base, None, 0, places.version)
