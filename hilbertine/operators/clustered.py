"""Rows and leaves stored once in the same buckets, so that looking leaves up again moves only the rows that have left theirs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .leaves import find_leaf

#: Slots of one piece of a leaf: a leaf of any size, say of equal keys, is stored in pieces that lie in different buckets.
PIECE = 1_000_000
NO_LEAF = -1


@dataclass(frozen=True)
class Clustered:
    """Two bucketed tables at ``path``, known to the session by names of their own until ``forget``; the files stay."""

    spark: SparkSession
    path: str
    names: tuple[str, str]

    @property
    def rows(self) -> DataFrame:
        """The rows, with ``home`` and ``piece``, by which they are stored: the leaf, or -1, and the block of slots."""
        return self.spark.table(self.names[0])

    @property
    def leaves(self) -> DataFrame:
        return self.spark.table(self.names[1])

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def store(rows: DataFrame, leaves: DataFrame, path: str, buckets: int) -> Clustered:
    """Write rows (slot, key, leaf, ...) and leaves (leaf, begin, end, key_begin, key_last, ...) below ``path``.

    Both are bucketed by leaf and piece, and sorted by leaf and key within a bucket: a join or a count by leaf
    needs no exchange, and files hold runs of keys, whose statistics let scans of a key range skip row groups. Slots should be dealt by leaf, so
    that a leaf's are together; a row that lies elsewhere is looked up again, no more. Rows outside all leaves are stored by slot.
    """
    spark, own = rows.sparkSession, uuid.uuid4().hex
    spread = rows.drop("leaf").columns
    homes = rows.select(*spread, F.coalesce("leaf", F.lit(NO_LEAF)).cast("long").alias("home"), F.expr(f"slot div {PIECE}").alias("piece"))
    pieces = leaves.select(F.col("leaf").cast("long").alias("home"), "key_begin", "key_last", "begin", "end", "level", F.explode(F.expr(f"sequence(begin div {PIECE}, greatest(begin, end - 1) div {PIECE})")).alias("piece"))
    names = (f"rows_{own}", f"leaves_{own}")
    for df, name, order in ((homes, names[0], "key"), (pieces, names[1], "key_begin")):
        # dealt as the buckets are, so that each has one file
        df.repartition(buckets, "home", "piece").write.bucketBy(buckets, "home", "piece").sortBy("home", order).option("path", f"{path}/{name.split('_')[0]}").format("parquet").saveAsTable(name)
    return Clustered(spark, path, names)


def opened(spark: SparkSession, path: str, buckets: int) -> Clustered:
    """What ``store`` has written at ``path``, in another session."""
    own = uuid.uuid4().hex
    names = (f"rows_{own}", f"leaves_{own}")
    for name, order in zip(names, ("key", "key_begin"), strict=True):
        folder = f"{path}/{name.split('_')[0]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (home, piece) sorted by (home, {order}) into {buckets} buckets location '{folder}'")
    return Clustered(spark, path, names)


def stayers(moved: DataFrame, clustered: Clustered) -> DataFrame:
    """``moved`` with ``stays``: whether the key still lies in the cube of the leaf that the row is stored by.

    ``moved`` keeps home and piece of the stored rows that it was made of, so that this join exchanges nothing.
    """
    cubes = clustered.leaves.select("home", "piece", "key_begin", "key_last")
    return moved.join(cubes, ["home", "piece"], "left").withColumn("stays", F.expr("coalesce(key between key_begin and key_last, false)")).drop("key_begin", "key_last")


def renewed(moved: DataFrame, clustered: Clustered) -> DataFrame:
    """``moved`` with ``leaf``: rows that stay have theirs from the store; only the others are looked up among all leaves."""
    marked = stayers(moved, clustered)
    kept = marked.filter("stays").withColumn("leaf", F.col("home"))
    whole = clustered.leaves.groupBy("home").agg(F.first("key_begin").alias("key_begin"), F.first("key_last").alias("key_last"), F.first("level").alias("level")).withColumnRenamed("home", "leaf")
    left = find_leaf(marked.filter("not stays"), whole)
    out = [c for c in moved.columns if c not in ("home", "piece")]
    return kept.select(*out, "leaf").unionByName(left.select(*out, "leaf"))


def rows_between(clustered: Clustered, low: int, high: int) -> DataFrame:
    """Stored rows with keys from ``low`` to ``high``: a scan whose filter reaches the files' statistics."""
    return clustered.rows.filter((F.col("key") >= low) & (F.col("key") <= high))
