"""Deterministic order without a global sort in one task, permutations and gathers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..sources.shared import written

#: Rows that one task orders, rows of a sample for each such range, and most ranges; beyond their product a task's rows grow, and are sorted on disk.
RANGE_ROWS, SAMPLED, RANGES = 100_000, 20, 1 << 17
#: Most changed rows whose permutation is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
LEAST = -(2**63)


@dataclass(frozen=True)
class Cuts:
    """Where ranges of (key, tie-break) begin, in ascending order; without tie-breaks a range begins with its key."""

    keys: tuple[int, ...] = ()
    ties: tuple[int, ...] = ()

    def __len__(self) -> int:
        return len(self.keys)

    def range_of(self, by: str, tie: str | None = None) -> Column:
        """The range that a row falls into: how many cuts are at most it.

        A binary search: of the literal table of cuts, as many elements are looked at as its length has bits.
        """
        if not self.keys:
            return F.lit(0)
        steps = ", ".join(str(1 << k) for k in reversed(range(len(self.keys).bit_length())))
        table = lambda values: f"array({', '.join(_literal(v) for v in values)})"
        found, key = f"element_at({table(self.keys)}, at + step)", f"coalesce({by}, {_literal(LEAST)})"
        at_most = f"{found} <= {key}"
        if self.ties and tie:
            at_most = f"({found} < {key} or ({found} = {key} and element_at({table(self.ties)}, at + step) <= coalesce({tie}, {_literal(LEAST)})))"
        return F.expr(f"aggregate(array({steps}), 0, (at, step) -> if(at + step <= {len(self.keys)} and {at_most}, at + step, at))")


def _literal(value: int) -> str:
    return f"{value}L" if value > LEAST else f"({LEAST + 1}L - 1L)"


def range_cuts(df: DataFrame, by: str, n: int, rows_per_range: int = RANGE_ROWS, tie: str | None = None) -> Cuts:
    """Cuts of the bigint column ``by``, or of it and then ``tie``, that make ranges of about equal size of ``df``'s ``n`` rows.

    Cuts are quantiles of a sample of ``SAMPLED`` rows a range, so that only their sizes depend on chance, not what is in them.
    With a tie-break a single key of many rows is cut, too. Nulls come first, as if they were the least bigint, which must not occur beside them.
    """
    parts = min(RANGES, -(-n // rows_per_range))
    if parts <= 1:
        return Cuts()
    chosen = df.select(F.coalesce(by, F.lit(LEAST)).alias("k"), (F.coalesce(tie, F.lit(LEAST)) if tie else F.lit(0).cast("long")).alias("t"))
    sample = chosen.sample(min(1.0, SAMPLED * parts / n), seed=1).toArrow()
    keys, ties = (np.asarray(sample.column(c)) for c in ("k", "t"))
    rows = np.lexsort((ties, keys))[np.arange(1, parts) * len(keys) // parts] if len(keys) else []
    cuts = sorted({(int(keys[i]), int(ties[i])) for i in rows})
    return Cuts(tuple(k for k, _ in cuts), tuple(t for _, t in cuts) if tie else ())


def running_sum(df: DataFrame, by: str, value: str, out: str, block: int = RANGE_ROWS, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of a smaller ``by`` (a bigint from 0, no two alike), overall or within groups.

    Rows are summed in blocks of ``by`` and shifted by what the blocks before hold.
    """
    dealt = df.withColumn("__block", F.expr(f"{by} div {block}"))
    sums = dealt.groupBy("__block", *within).agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*within or [F.lit(0)]).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("__block", *within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(before, ["__block", *within]).withColumn(out, F.col(out) + F.col("__before")).select(*df.columns, out)


def ranked(df: DataFrame, by: str, then: list[str], out: str, within: str | list[str] | None = None, rows_per_range: int = RANGE_ROWS, n: int | None = None) -> DataFrame:
    """``df`` with ``out``: each row's place (from 0) in the order of ``by`` (a bigint column), then ``then``, overall or within groups.

    Rows are dealt over ranges of ``by``, numbered in each, and shifted by what the
    ranges before hold; a range's count is all that leaves its task. Where one value of ``by`` has more rows
    than a range, and the first column of ``then`` is a bigint, too, ranges are cut within that value. ``n`` is the number of rows, if known.
    """
    groups = [within] if isinstance(within, str) else list(within or [])
    tie = then[0] if then and isinstance(then[0], str) and isinstance(df.schema[then[0]].dataType, LongType) else None
    cuts = range_cuts(df, by, df.count() if n is None else n, rows_per_range, tie)
    dealt = df.withColumn("__range", cuts.range_of(by, tie))
    order = Window.partitionBy("__range", *groups).orderBy(by, *then)
    numbered = dealt.withColumn(out, F.row_number().over(order).cast("long") - 1)
    if not len(cuts):
        return numbered.drop("__range")
    counts = dealt.groupBy("__range", *groups).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*groups or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    joined = numbered.join(before, ["__range", *groups])
    return joined.withColumn(out, F.col(out) + F.col("__before")).select(*df.columns, out)


def sort_permutation(rows: DataFrame, key: str = "key", slot: str = "slot") -> DataFrame:
    """(new_slot, old_slot) of the total order by key and then slot: new slot i takes what old_slot held."""
    return ranked(rows.select(F.col(key).alias("key"), F.col(slot).alias("old_slot")), "key", ["old_slot"], "new_slot").select("new_slot", "old_slot")


def radix_ranked(df: DataFrame, by: str, then: list[str], out: str, digit: int = 10, bits: int = 63, most: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``out``: the place of each row in the order of ``by`` (a bigint of at most ``bits`` bits, not negative), then ``then``.

    A radix order by leading digits, as a tree of histograms: rows are counted by their first ``digit`` bits; prefixes of more than ``most``
    rows stay open, and rows that join the table of open prefixes are counted by a digit more, until none is open or the
    digits end. Each bucket is ordered by itself and begins where the smaller ones end, by prefix sums. Prefixes and counts
    stay in tables of the shared folder; the driver learns only whether any prefix is open, once a digit. A value of
    more than ``most`` rows is a bucket that ``ranked`` cuts by its tie-break.
    """
    shifts = list(range(bits, 0, -digit))[1:] + [0]
    tagged = df.withColumn("__shift", F.lit(None).cast("int"))  # the digit at which a row's bucket closed
    levels: list[DataFrame] = []
    open_ = None
    for shift in shifts:
        prefix = F.expr(f"shiftright({by}, {shift})")
        inner = df if open_ is None else df.join(open_, F.expr(f"shiftright({by}, {above})") == F.col("__open"), "left_semi")
        counts = written(inner.groupBy(prefix.alias("__prefix")).agg(F.count("*").alias("__n")))
        closed = counts.filter(F.col("__n") <= most) if shift else counts
        levels.append(closed.select(F.lit(shift).alias("__shift"), "__prefix", "__n"))
        open_, above = counts.filter(F.col("__n") > most).select(F.col("__prefix").alias("__open")), shift
        tagged = tagged.join(open_.withColumnRenamed("__open", "__p"), prefix == F.col("__p"), "left")
        tagged = tagged.withColumn("__shift", F.expr(f"coalesce(__shift, if(__p is null, {shift}, null))")).drop("__p")
        if not shift or open_.isEmpty():
            break
    buckets = reduce(DataFrame.unionByName, levels)
    # starts: a prefix sum over the first digits, and one within each
    first = F.expr(f"shiftright(shiftleft(__prefix, __shift), {max(0, bits - digit)})")
    buckets = buckets.withColumn("__first", first).withColumn("__low", F.expr("shiftleft(__prefix, __shift)"))
    tops = buckets.groupBy("__first").agg(F.sum("__n").alias("__sum"))
    tops = tops.select("__first", F.coalesce(F.sum("__sum").over(Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__first").orderBy("__low").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("__start", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(tops, "__first").select("__shift", "__prefix", "__n", (F.col("__start") + F.col("__base")).alias("__start"))
    whole = F.coalesce("__shift", F.lit(0))
    placed = tagged.withColumn("__shift", whole).withColumn("__prefix", F.expr(f"shiftright({by}, __shift)")).join(starts, ["__shift", "__prefix"])
    order = Window.partitionBy("__shift", "__prefix").orderBy(by, *then)
    small = placed.filter(F.col("__n") <= most).withColumn(out, F.col("__start") + F.row_number().over(order) - 1)
    if shift:  # no value has more rows than a task orders
        return small.select(*df.columns, out)
    large = placed.filter(F.col("__n") > most)
    tie = then[0] if then and isinstance(df.schema[then[0]].dataType, LongType) else by
    large = ranked(large, tie, then[1:] if tie != by else then, "__nth", within="__prefix", rows_per_range=most).withColumn(out, F.col("__start") + F.col("__nth"))
    return small.select(*df.columns, out).unionByName(large.select(*df.columns, out))


def inverse(perm: DataFrame) -> DataFrame:
    return perm.selectExpr("old_slot as new_slot", "new_slot as old_slot")


def gather(rows: DataFrame, perm: DataFrame, slot: str = "slot") -> DataFrame:
    """Rows with the slots that the permutation gives them; slots that it lacks go."""
    moved = rows.join(perm.withColumnRenamed("old_slot", slot), slot)
    return moved.withColumn(slot, F.col("new_slot")).select(*rows.columns)


def count_changed(perm: DataFrame) -> DataFrame:
    return perm.agg(F.count_if(F.col("new_slot") != F.col("old_slot")).alias("changed"))


def apply_permutation(rows: DataFrame, perm: DataFrame, slot: str = "slot") -> DataFrame:
    """Gather by the cheaper way: nothing if nothing moves, all rows if a quarter or more do, else only those.

    The moved rows are broadcast where they are at most ``BROADCAST_ROWS``, and joined by a shuffle beyond that.
    """
    n, changed = perm.agg(F.count("*"), F.count_if(F.col("new_slot") != F.col("old_slot"))).first()
    if not changed:
        return rows
    if 4 * changed >= n:
        return gather(rows, perm, slot)
    moves = perm.filter("new_slot <> old_slot").withColumnRenamed("old_slot", slot)
    moves = F.broadcast(moves) if changed <= BROADCAST_ROWS else moves
    return rows.join(moves, slot, "left").withColumn(slot, F.coalesce("new_slot", slot)).select(*rows.columns)


def reshuffle_all(tables: dict[str, DataFrame], perm: DataFrame, slot: str = "slot") -> dict[str, DataFrame]:
    """The same permutation over several tables; each must have a row for every slot of it."""
    n = perm.count()
    for name, rows in tables.items():
        if rows.count() < n:
            raise ValueError(f"table {name} has fewer rows than the permutation")
    return {name: gather(rows, perm, slot) for name, rows in tables.items()}


def swap_rows(rows: DataFrame, a: int, b: int, slot: str = "slot") -> DataFrame:
    s = F.col(slot)
    return rows.withColumn(slot, F.when(s == a, b).when(s == b, a).otherwise(s).cast("long"))


def swap_pairs_of_rows(rows: DataFrame, pairs: DataFrame, slot: str = "slot") -> DataFrame:
    """Rows with the slots of all disjoint pairs (i, j) exchanged."""
    moves = pairs.selectExpr("i as new_slot", "j as old_slot").union(pairs.selectExpr("j as new_slot", "i as old_slot")).withColumnRenamed("old_slot", slot)
    return rows.join(moves, slot, "left").withColumn(slot, F.coalesce("new_slot", slot)).select(*rows.columns)


#: A registry refuses more arrays than this.
REGISTRY_ARRAYS = 32


class Registry:
    """The arrays that move together: bytes of an element and rows of each."""

    def __init__(self, sizes: dict[str, int] | None = None, rows: dict[str, int] | None = None) -> None:
        self.arrays: dict[str, tuple[int, int]] = {}
        for name, size in (sizes or {}).items():
            self.add(name, size, (rows or {}).get(name, 0))

    def add(self, name: str, size: int, rows: int) -> None:
        if len(self.arrays) >= REGISTRY_ARRAYS:
            raise ValueError(f"more than {REGISTRY_ARRAYS} arrays")
        self.arrays[name] = (size, rows)

    def clear(self) -> None:
        self.arrays.clear()

    def report(self) -> dict[str, int]:
        return {"size": len(self.arrays), "max_elem_size": max((s for s, _ in self.arrays.values()), default=0), "max_elem_bytes": max((s * n for s, n in self.arrays.values()), default=0)}


def type_permutations(rows: DataFrame, perm: DataFrame) -> DataFrame:
    """For each payload type (gas 0, star 4, black hole 5): the permutation of its own table that follows ``perm``.

    ``rows``: slot, ptype, type_idx before the order. A staged type is taken as bare. (ptype, new_idx, old_idx).
    """
    bare = rows.withColumn("ptype", F.expr("ptype & 127")).filter("ptype in (0, 4, 5)")
    moved = bare.join(perm.withColumnRenamed("old_slot", "slot"), "slot")
    return ranked(moved.select("ptype", "new_slot", F.col("type_idx").alias("old_idx")), "new_slot", [], "new_idx", within="ptype").select("ptype", "new_idx", "old_idx")


def subsort_leaf(rows: DataFrame) -> DataFrame:
    """Slots within each leaf (leaf, begin) by type, then key, then slot."""
    order = Window.partitionBy("leaf").orderBy("ptype", "key", "slot")
    return rows.withColumn("new_slot", F.col("begin") + F.row_number().over(order) - 1)
