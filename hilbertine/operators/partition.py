"""Keeping rows dealt by leaf and type while they move."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cubes
from ..functions.hilbert import with_hilbert_key
from ..sources.random import drawn
from .leaves import find_leaf
from .order import ranked, running_sum


def perturb(rows: DataFrame, delta: int, iteration: int = 0) -> DataFrame:
    """Rows (id, x, y, z) moved by -delta to delta along each axis and keyed anew.

    The step is linear-congruential in id, iteration and axis, so that it doesn't depend on order.
    """
    out = rows
    for i, c in enumerate("xyz"):
        step = f"((id * {1103515245 + 2 * i} + {iteration * 12345 + 7919 * (i + 1)}) % {2 * delta + 1}) - {delta}"
        out = out.withColumn(c, F.expr(f"cast({cubes.clamp(f'{c} + {step}')} as bigint)"))
    return with_hilbert_key(out.drop("key") if "key" in rows.columns else out)


def perturb_in_order(rows: DataFrame, delta: int, n: int, iteration: int = 0, seed: int = 24680) -> DataFrame:
    """Rows (slot, x, y, z) moved as a loop over all ``n`` slots moves them that draws three numbers a row from one generator, and keyed anew.

    A row's numbers are found by jumping ahead in the one sequence, past those of the slots and iterations before, so that
    the result doesn't depend on how rows are dealt. The seed is a fixed value of the published loop.
    """
    if not delta:
        return with_hilbert_key(rows.drop("key"))

    @F.pandas_udf("x long, y long, z long")
    def steps(slot: pd.Series) -> pd.DataFrame:
        found = drawn(seed, slot.to_numpy() + iteration * n, 3) % np.uint64(2 * delta + 1)
        return pd.DataFrame(found.astype(np.int64) - delta, columns=["x", "y", "z"])

    out = rows.withColumn("__step", steps("slot"))
    for c in "xyz":
        out = out.withColumn(c, F.expr(f"cast({cubes.clamp(f'{c} + __step.{c}')} as bigint)"))
    return with_hilbert_key(out.drop("__step", "key"))


def dealt(rows: DataFrame, leaves: DataFrame, n: int | None = None) -> DataFrame:
    """Rows (slot, key, ptype, ...) with ``leaf`` and ``new_slot``: by leaf, gas first in each, else in their order; rows outside all leaves last.

    One lookup and one numbering; all columns travel along, so that no gather follows. ``n``: how many rows there are, if known.
    """
    n = rows.count() if n is None else n
    # leaves are numbered from 0, so that this bucket is behind all of theirs
    bucket = find_leaf(rows, leaves, n=n).withColumn("__bucket", F.coalesce(F.col("leaf") * 2 + F.expr("if(ptype = 0, 0, 1)"), F.lit(2**62) + F.expr("if(ptype = 0, 0, 1)")))
    return ranked(bucket, "__bucket", ["slot"], "new_slot", n=n).drop("__bucket")


def partition_permutation(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """(new_slot, old_slot, leaf) of ``dealt``."""
    return dealt(rows.select("slot", "key", "ptype"), leaves).selectExpr("new_slot", "slot as old_slot", "leaf")


def leaf_histogram(homes: DataFrame) -> DataFrame:
    """Rows and gas of each leaf that has any (leaf, ptype)."""
    return homes.filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"), F.count_if(F.col("ptype") == 0).alias("n_gas"))


def updated_ranges(leaves: DataFrame, homes: DataFrame) -> DataFrame:
    """Leaves with the ranges of the rows that are in them now; an empty leaf keeps its place with no width."""
    counts = leaves.select("leaf").join(leaf_histogram(homes), "leaf", "left").na.fill(0, ["n", "n_gas"])
    return running_sum(counts, "leaf", "n", "begin").selectExpr("leaf", "begin", "begin + n as end", "begin as gas_begin", "begin + n_gas as gas_end")


def partition_violations(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(what, slot) for each row (slot, leaf, ptype) that isn't in its leaf's range, or on the wrong side of its gas."""
    met = rows.join(ranges, "leaf", "left")
    placed = met.filter("leaf is not null")
    wrong = placed.filter("slot < begin or slot >= end").selectExpr("'range' as what", "slot")
    gas = placed.filter("(ptype = 0) <> (slot < gas_end)").selectExpr("'gas' as what", "slot")
    edge = ranges.agg(F.max("end")).first()[0] or 0
    outside = met.filter("leaf is null").filter(F.col("slot") < edge).selectExpr("'outside' as what", "slot")
    return wrong.unionByName(gas).unionByName(outside)


def order_violations(rows: DataFrame, key: str = "key", slot: str = "slot") -> DataFrame:
    """Slots whose key is less than that of the slot before."""
    after = rows.selectExpr(f"{slot} - 1 as __s", f"{key} as __k", f"{slot} as at")
    return rows.select(F.col(slot).alias("__s"), F.col(key).alias("__before")).join(after, "__s").filter("__k < __before").select("at")


def permutation_violations(before: DataFrame, after: DataFrame, perm: DataFrame) -> DataFrame:
    """New slots whose id or type isn't that of the slot that they took."""
    want = perm.join(before.selectExpr("slot as old_slot", "id as want_id", "ptype as want_type"), "old_slot")
    got = after.selectExpr("slot as new_slot", "id", "ptype")
    return want.join(got, "new_slot", "left").filter("not (id <=> want_id and ptype <=> want_type)").select("new_slot")
