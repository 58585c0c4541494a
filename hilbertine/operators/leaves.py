"""Leaves: tiling ordered keys into Hilbert cubes, and looking keys up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cubes
from ..functions.flags import LEAF_FLAGS
from ..functions.hilbert import BITS, CELLS
from .order import range_cuts

#: Rows of one block of consecutive slots.
BLOCK_ROWS = 100_000
#: Most leaves that are broadcast to a lookup (32 bytes each).
BROADCAST_LEAVES = 500_000


def build_leaves(rows: DataFrame, target: int, tolerance: float = 0.5, max_side: int = CELLS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Greedy tiling of rows (slot, key), numbered in the order of their keys, into cubes.

    A leaf takes the largest cube around its first row that is at most ``max_side``
    wide, holds no more rows than the tolerance allows and starts after the
    leaf before. In closed form: a row's own cube follows from the keys one before,
    and target - 1 and most rows after it; and it starts a leaf if no
    earlier row's cube reaches it. Slots are dealt in blocks; a block also gets
    the few rows after it and the one before, and the furthest cube of the blocks before.

    Returns leaf, begin, end, level, key_begin, key_last, side_cells, underfull, overfull.
    """
    least, most = cubes.bounds(target, tolerance)
    reach = max(target, most)
    block_rows = max(block_rows, reach + 1)
    n = rows.count()
    side_level = cubes.level_for_side(max_side)
    block = f"cast(slot div {block_rows} as int)"
    copies = f"array_compact(array({block}, if(slot % {block_rows} < {reach} and slot >= {block_rows}, {block} - 1, null), if(slot % {block_rows} = {block_rows - 1}, {block} + 1, null)))"
    dealt = rows.select("slot", "key", F.expr(block).alias("home"), F.explode(F.expr(copies)).alias("block"))
    order = Window.partitionBy("block").orderBy("slot")
    near = dealt.select(
        "*", F.lag("key").over(order).alias("before"), F.lead("key", max(target - 1, 0)).over(order).alias("goal") if target > 1 else F.col("key").alias("goal"),
        F.lead("key", most).over(order).alias("beyond"), F.max("key").over(Window.partitionBy("block")).alias("final"),
    ).filter("block = home")
    level = (
        f"least({BITS}, greatest({side_level}, {cubes.common_level('key', 'coalesce(goal, final)')}, "
        f"if(before is null, 0, {cubes.common_level('before', 'key')} + 1), if(beyond is null, 0, {cubes.common_level('key', 'beyond')} + 1)))"
    )
    cube = near.withColumn("level", F.expr(level)).withColumn("key_last", F.expr(cubes.key_last("key", "level"))).select("slot", "key", "block", "level", "key_last")
    furthest = cube.groupBy("block").agg(F.max("key_last").alias("reach")).withColumn("earlier", F.max("reach").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("reach")
    within = Window.partitionBy("block").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each block
    starts = (
        cube.withColumn("so_far", F.max("key_last").over(within)).join(F.broadcast(furthest), "block")
        .filter("coalesce(greatest(so_far, earlier), -1) < key")
    )
    follow = Window.partitionBy("block").orderBy("slot")
    firsts = starts.groupBy("block").agg(F.min("slot").alias("first"), F.count("*").alias("n"))
    chain = Window.orderBy("block")
    firsts = firsts.withColumn("next_first", F.lead("first").over(chain)).withColumn("leaf_before", F.coalesce(F.sum("n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("first", "n")
    placed = starts.withColumn("place", F.row_number().over(follow)).withColumn("next", F.lead("slot").over(follow)).join(F.broadcast(firsts), "block")
    leaves = placed.select(
        (F.col("leaf_before") + F.col("place") - 1).alias("leaf"), F.col("slot").alias("begin"), F.coalesce("next", "next_first", F.lit(n)).cast("long").alias("end"), "level",
        F.expr(cubes.key_begin("key", "level")).alias("key_begin"), "key_last", F.expr(cubes.side("level")).alias("side_cells"),
    )
    count = F.col("end") - F.col("begin")
    return leaves.withColumn("underfull", count < least).withColumn("overfull", count > most)


def prefix_runs(rows: DataFrame, level: int) -> DataFrame:
    """prefix, first, past: the run of slots of each cube of a level, of rows (slot, key) numbered in the order of their keys."""
    runs = rows.groupBy(F.expr(cubes.prefix("key", str(level))).alias("prefix"))
    return runs.agg(F.min("slot").alias("first"), (F.max("slot") + 1).alias("past"))


def find_leaf(keys: DataFrame, leaves: DataFrame, key: str = "key", broadcast_leaves: int = BROADCAST_LEAVES, n: int | None = None) -> DataFrame:
    """``keys`` with ``leaf``: the leaf whose cube holds the key, or null.

    Cubes don't overlap, and there is one way for few leaves and one for any number. Up to
    ``broadcast_leaves`` leaves are broadcast: a cube of level l is found by the key's first
    3 l bits, for each level that leaves have. Beyond, keys and leaves are dealt over the same
    ranges of the key, and a key takes the last leaf that has begun; of each range only that last
    leaf is gathered. Either way the keys are read once. ``n``: how many keys there are, if known.
    """
    found = {r["level"]: r["count"] for r in leaves.groupBy("level").count().collect()}  # 22 rows at most
    if not found:
        return keys.withColumn("leaf", F.lit(None).cast("long"))
    if sum(found.values()) > broadcast_leaves:
        return _find_by_ranges(keys, leaves, key, sum(found.values()) + (keys.count() if n is None else n))
    cut = leaves.select(F.col("level").alias("__level"), F.expr(cubes.prefix("key_begin", "level")).alias("__prefix"), F.col("leaf").alias("__leaf"))
    out = keys
    for level in sorted(found):
        one = cut.filter(F.col("__level") == level).select(F.col("__prefix").alias(f"__p{level}"), F.col("__leaf").alias(f"__l{level}"))
        out = out.join(F.broadcast(one), F.expr(cubes.prefix(key, str(level))) == F.col(f"__p{level}"), "left").drop(f"__p{level}")
    return out.withColumn("leaf", F.coalesce(*[f"__l{x}" for x in sorted(found)])).drop(*[f"__l{x}" for x in sorted(found)])


def _find_by_ranges(keys: DataFrame, leaves: DataFrame, key: str, n: int, rows_per_range: int = BLOCK_ROWS) -> DataFrame:
    cut = leaves.select(F.col("key_begin").alias("__key"), F.struct("leaf", "key_last").alias("__here"))
    cuts = range_cuts(keys.select(F.col(key).alias("__key")).union(cut.select("__key")), "__key", n, rows_per_range)
    events = keys.select(F.col(key).alias("__key"), F.struct("*").alias("__row")).unionByName(cut, allowMissingColumns=True).withColumn("__range", cuts.range_of("__key"))
    last = cut.groupBy(cuts.range_of("__key").alias("__range")).agg(F.max_by("__here", "__key").alias("__end")).collect()  # a row a range
    carried, now, ends = [], None, {r["__range"]: r["__end"] for r in last}
    for r in range(len(cuts) + 1):
        carried.append((r, now))
        now = (ends[r]["leaf"], ends[r]["key_last"]) if r in ends else now
    before = F.broadcast(keys.sparkSession.createDataFrame(carried, "__range int, __carried struct<leaf: bigint, key_last: bigint>"))
    so_far = Window.partitionBy("__range").orderBy("__key", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = events.withColumn("__at", F.last("__here", ignorenulls=True).over(so_far)).filter("__row is not null").join(before, "__range")
    at = at.withColumn("__at", F.coalesce("__at", "__carried"))
    return at.select("__row.*", F.when(F.col("__key") <= F.col("__at.key_last"), F.col("__at.leaf")).cast("long").alias("leaf"))


def coverage_violations(leaves: DataFrame, rows: DataFrame, max_side: int = CELLS) -> DataFrame:
    """(what, leaf) for each breach: a gap or overlap, a key outside its cube, a cube too wide, rows not covered.

    A leaf is compared with the one numbered before it by a join.
    """
    before = leaves.selectExpr("leaf + 1 as leaf", "end as prev_end", "key_last as prev_last")
    chain = leaves.select("leaf", "begin", "key_begin").join(before, "leaf", "left")
    gaps = chain.filter("begin <> coalesce(prev_end, 0) or prev_last >= key_begin or (leaf > 0 and prev_end is null)").selectExpr("'gap' as what", "leaf")
    wide = leaves.filter(F.col("side_cells") > max(max_side, 1)).selectExpr("'side' as what", "leaf")
    homes = find_leaf(rows.select("slot", "key"), leaves).withColumnRenamed("leaf", "at")
    spans = leaves.select(F.col("leaf").alias("at"), "begin", "end")
    outside = homes.join(spans, "at", "left").filter("at is null or slot < begin or slot >= end").selectExpr("'key' as what", "at as leaf")
    n = rows.count()
    total = leaves.agg(F.coalesce(F.max("end"), F.lit(0)).alias("covered")).filter(F.col("covered") != n).selectExpr("'total' as what", "cast(null as bigint) as leaf")
    return gaps.unionByName(wide).unionByName(outside).unionByName(total)


def type_counts(rows: DataFrame) -> DataFrame:
    """Per leaf: type_count and the running type_offset of types 0 to 5, from begin."""
    t = [F.count_if(F.col("ptype") == i) for i in range(6)]
    counts = rows.groupBy("leaf").agg(F.array(*t).alias("type_count"), F.min("begin").alias("begin"))
    return with_offsets(counts)


def with_offsets(leaves: DataFrame) -> DataFrame:
    """Exclusive running sums of type_count, from begin, and the end after the last."""
    running = "transform(sequence(0, 5), i -> begin + aggregate(slice(type_count, 1, i), 0L, (a, x) -> a + x))"
    return leaves.withColumn("type_offset", F.expr(running)).withColumn("common_end", F.expr("begin + aggregate(type_count, 0L, (a, x) -> a + x)"))


def leaf_state(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """The table that is kept while rows change: leaf, type_count, type_offset, flags; one count of the rows (leaf, ptype), a leaf without rows among them.

    Types with the staged bit count as staged only. Afterwards deltas are merged into it (``mutate.merge_conversions``).
    """
    counts = rows.groupBy("leaf").agg(F.array(*[F.count_if(F.col("ptype") == i) for i in range(6)]).alias("__n"), F.count_if(F.expr("ptype >= 128")).alias("__staged"))
    met = leaves.select("leaf", "begin").join(counts, "leaf", "left").withColumn("type_count", F.coalesce("__n", F.expr("array_repeat(0L, 6)")))
    has = {"HasGas": "type_count[0] > 0", "HasDM": "type_count[1] + type_count[2] + type_count[3] > 0", "HasStar": "type_count[4] > 0", "HasBH": "type_count[5] > 0", "HasStaged": "coalesce(__staged, 0) > 0"}
    flags = " + ".join(f"if({test}, {LEAF_FLAGS[name]}, 0)" for name, test in has.items())
    return with_offsets(met).select("leaf", "type_count", "type_offset", F.expr(flags).alias("flags"))


def leaf_moments(rows: DataFrame) -> DataFrame:
    """Extension: total mass and centre of mass of each leaf (x, y, z, mass)."""
    weighted = [(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"com_{c}") for c in "xyz"]
    return rows.groupBy("leaf").agg(F.sum("mass").alias("total_mass"), *weighted)
