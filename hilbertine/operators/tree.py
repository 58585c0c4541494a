"""The tree above the leaves: for every cube that holds any, its place, size, rows, mass and centre of mass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cubes
from ..functions.hilbert import BITS, CELLS


def octree(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """level, prefix, parent (prefix one level up, null for the root), is_leaf, centre_x to centre_z, half_width, n, mass, com_x to com_z.

    ``rows``: leaf, x, y, z, mass (of any exact type: sums then don't depend on order). Rows are summed into their leaves first; each leaf's
    sums go to all the cubes above it at once, 21 at most, and are added up in one exchange, whose map side leaves
    of the upper cubes a row a task. A cube's corner follows from any row in it. Rows without a leaf count nowhere.
    """
    moments = [F.sum(F.col("mass") * F.col(c)).alias(f"m{c}") for c in "xyz"]
    sums = rows.filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), *moments, *[F.min(c).alias(c) for c in "xyz"])
    full = leaves.select("leaf", F.col("level").alias("own"), "key_begin").join(sums, "leaf")
    above = full.select("*", F.explode(F.expr("sequence(0, cast(own as int))")).alias("level"))
    at = above.withColumn("prefix", F.expr(cubes.prefix("key_begin", "level"))).withColumn("width", F.expr(f"shiftleft(1L, {BITS} - level)"))
    corners = [F.first(F.expr(f"{c} - {c} % width")).alias(f"corner_{c}") for c in "xyz"]
    nodes = at.groupBy("level", "prefix").agg(F.max(F.col("own") == F.col("level")).alias("is_leaf"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), *[F.sum(f"m{c}").alias(f"m{c}") for c in "xyz"], *corners)
    half = F.expr(f"{CELLS} / cast(shiftleft(2L, level) as double)")
    return nodes.select(
        F.col("level").cast("long").alias("level"), "prefix", F.expr("if(level = 0, null, shiftright(prefix, 3))").alias("parent"), "is_leaf",
        *[(F.col(f"corner_{c}") + half).alias(f"centre_{c}") for c in "xyz"], half.alias("half_width"), "n", "mass",
        *[(F.col(f"m{c}").cast("double") / F.col("mass").cast("double")).alias(f"com_{c}") for c in "xyz"],
    )
