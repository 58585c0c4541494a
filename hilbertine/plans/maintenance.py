"""The leaf-maintenance loop: key, order, tile, and keep rows dealt by leaf while they move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hilbert import CELLS, with_hilbert_key
from ..operators.leaves import build_leaves, find_leaf
from ..operators.order import ranked
from ..operators.partition import dealt, perturb, updated_ranges
from ..sources.shared import written


def slotted(particles: DataFrame) -> DataFrame:
    """Particles (id, x, y, z, ptype) with key and slot: their place by key and then id.

    Numbering and every later step read these rows more than once, so they are written to the shared folder, before and after: keys are
    computed once, and later plans hold a scan in place of the key's lookups.
    """
    return written(ranked(written(with_hilbert_key(particles)), "key", ["id"], "slot"))


def leaf_occupancy(particles: DataFrame, target: int = 32, tolerance: float = 0.5, max_side: int = CELLS) -> DataFrame:
    """Rows of each type in each leaf."""
    rows = slotted(particles)
    homes = find_leaf(rows, written(build_leaves(rows, target, tolerance, max_side)))
    return homes.groupBy("leaf", "ptype").agg(F.count("*").alias("n"))


def maintain(particles: DataFrame, iterations: int, delta: int, target: int = 32, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Rows and leaf ranges after some rounds of moving, classifying and dealing.

    A round looks each row's leaf up once and deals the rows with all their columns. Each round's
    rows are written to the shared folder, so that a plan holds one round, however many there are, and a lost executor costs no more than that.
    """
    rows = slotted(particles)
    n = rows.count()
    leaves = written(build_leaves(rows, target, tolerance))
    homes = None
    for i in range(iterations):
        moved = written(perturb(rows, delta, i))  # its keys are computed once
        homes = written(dealt(moved, leaves, n).withColumn("slot", F.col("new_slot")).drop("new_slot"))
        rows = homes.drop("leaf")
    return rows, leaves if homes is None else updated_ranges(leaves, homes)
