"""Changing a row's type within its leaf, staging such changes, and compaction."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import GAS, STAGED, STAR
from ..functions.flags import LEAF_FLAGS, PARTICLE_FLAGS
from ..sources.shared import written
from .layouts import PAYLOADS, Layout
from .order import ranked


def mutate_gas_to_star(rows: DataFrame, chosen: DataFrame, n_star: int, star_capacity: int | None = None) -> DataFrame:
    """Gas rows named by their ids become stars at the front of their leaf's stars.

    ``rows``: slot, leaf, ptype, type_idx, in type order within a leaf. ``chosen``: id,
    seq (any order of the requests): each is moved to the front after those before it, so
    that the last comes first. A new star's payload index is n_star and how many requests were granted before. Rows
    that aren't gas are refused and use up neither an index nor room. All other rows keep their order.
    """
    gas = rows.filter(F.col("ptype") == GAS).select("id")
    room = 2**62 if star_capacity is None else max(0, star_capacity - n_star)
    granted = ranked(chosen.select("id", F.col("seq").cast("long").alias("__seq")).join(gas, "id", "left_semi"), "__seq", ["id"], "__nth").filter(F.col("__nth") < room)
    marked = rows.join(granted.select("id", "__nth"), "id", "left").withColumn("__go", F.col("__nth").isNotNull())
    changed = marked.withColumn("ptype", F.when(F.col("__go"), STAR).otherwise(F.col("ptype")).cast(rows.schema["ptype"].dataType)).withColumn(
        "type_idx", F.when(F.col("__go"), n_star + F.col("__nth")).otherwise(F.col("type_idx")).cast("long")
    )
    first = F.min("slot").over(Window.partitionBy("leaf"))
    order = Window.partitionBy("leaf").orderBy("ptype", F.when(F.col("__go"), -F.col("__nth") - 1).otherwise(0), "slot")
    return changed.withColumn("__first", first).withColumn("slot", F.col("__first") + F.row_number().over(order) - 1).select(*rows.columns)


def _leaf_by_leaf(asked: DataFrame, answer: Callable[[list[tuple]], Iterable[tuple]], out: pa.Schema) -> DataFrame:
    """The rows that ``answer`` makes of each leaf's requests, (leaf, seq, j, n, first) in the order of seq, then j.

    Requests are dealt by leaf, sorted, and streamed through a task: a call of Spark's own for each leaf would take it
    milliseconds a leaf. One leaf's requests are in memory at a time.
    """
    columns = ["leaf", "seq", "j", "n", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        said = chain.from_iterable(answer(list(own)) for _, own in groupby(rows, key=itemgetter(0)))
        while part := list(islice(said, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), out.types, strict=True)], schema=out)

    types = {pa.int64(): "bigint", pa.bool_(): "boolean"}
    longs = [F.col(c).cast("long").alias(c) for c in columns]
    return asked.select(*longs).repartition("leaf").sortWithinPartitions("leaf", "seq", "j").mapInArrow(run, ", ".join(f"{f.name} {types[f.type]}" for f in out))


@dataclass(frozen=True)
class Converted:
    """What ``convert_gas`` changes: rows, the leaf table, and counters; ``stars`` (seq, star): each request's new index, or -1."""

    rows: DataFrame
    leaves: DataFrame
    stars: DataFrame
    counters: DataFrame


def convert_gas(rows: DataFrame, leaves: DataFrame, requests: DataFrame, n_gas: int, n_star: int, star_capacity: int | None = None, live_gas: bool = True) -> Converted:
    """Gas rows named by their place in a leaf become stars, with the leaf table kept up instead of counted anew.

    ``rows``: slot, leaf, ptype, type_idx, in type order within a leaf. ``leaves``: leaf, type_count, type_offset, flags, as
    ``leaves.leaf_state`` makes them and this function returns them. ``requests``: seq, leaf, j: the j-th gas row of the leaf as it is when the
    requests of smaller seq are done. Refused (-1, nothing changes) is a j that the leaf doesn't have, and whatever comes
    when the stars are at capacity. A granted row goes to the front of its leaf's stars.

    Only leaves with granted requests change: their counts, offsets and flags by a delta, their rows by it, too, for a row's new
    slot follows from its type, how many granted gas rows lay before it, and the delta. ``counters`` (n_gas, n_star): the
    fine layout counts gas that lives (``live_gas``), the coarse one what its table holds until compaction.
    """
    known = leaves.select("leaf", F.element_at("type_count", 1).alias("n"), F.element_at("type_offset", 1).alias("gas_at"), F.element_at("type_offset", STAR + 1).alias("star_at"))
    asked = requests.select(F.col("seq").cast("long").alias("seq"), "leaf", F.col("j").cast("long").alias("j")).join(known, "leaf", "left")
    room = 2**62 if star_capacity is None else max(0, star_capacity - n_star)

    def take(requests: list[tuple]) -> Iterator[tuple]:
        """Which places of the leaf's gas the requests take, one after the other: only requests are in memory, not rows."""
        taken: list[int] = []
        for _, seq, j, n, _ in requests:
            at = None
            if j is not None and 0 <= j < (n or 0) - len(taken):
                at = j + bisect_right(range(len(taken)), j, key=lambda i: taken[i] - i)  # those taken before it shift it
                insort(taken, at)
            yield seq, at

    places = written(_leaf_by_leaf(asked.withColumn("first", F.col("gas_at")), take, pa.schema([("seq", pa.int64()), ("at", pa.int64())])))  # a pair of numbers a request
    numbered = ranked(places.filter("at is not null"), "seq", [], "nth").filter(F.col("nth") < room)
    stars = requests.select(F.col("seq").cast("long").alias("seq")).join(numbered.select("seq", (F.col("nth") + n_star).alias("star")), "seq", "left").na.fill(-1, ["star"])
    granted = asked.join(numbered, "seq")
    nearest = F.row_number().over(Window.partitionBy("leaf").orderBy("nth"))  # the first granted lies right before the old stars, the last in front
    moves = granted.select((F.col("gas_at") + F.col("at")).alias("slot"), (F.col("nth") + n_star).cast("long").alias("__star"), (F.col("star_at") - nearest).alias("__to"))
    gone = granted.groupBy("leaf").agg(
        F.count("*").alias("__k"), F.first("gas_at").alias("__gas_at"), F.first("star_at").alias("__star_at"), F.sort_array(F.collect_list("at")).alias("__taken")
    )  # as many numbers as the leaf has requests
    delta = gone.select("leaf", "__k")
    changed = rows.join(moves, "slot", "left").join(gone, "leaf", "left")
    before = F.expr("case when slot >= __star_at then 0 when ptype = 0 then size(filter(__taken, t -> t < slot - __gas_at)) else __k end")
    slot = F.when(F.col("__star").isNotNull(), F.col("__to")).when(F.col("__k").isNotNull(), F.col("slot") - before).otherwise(F.col("slot"))
    moved = changed.withColumn("__slot", slot.cast("long")).withColumn("ptype", F.when(F.col("__star").isNotNull(), STAR).otherwise(F.col("ptype")).cast(rows.schema["ptype"].dataType))
    moved = moved.withColumn("type_idx", F.coalesce("__star", "type_idx")).withColumn("slot", F.col("__slot")).select(*rows.columns)
    made = delta.agg(F.coalesce(F.sum("__k"), F.lit(0)).cast("long").alias("made"))
    counters = made.select((F.lit(n_gas) - (F.col("made") if live_gas else F.lit(0))).cast("long").alias("n_gas"), (F.lit(n_star) + F.col("made")).cast("long").alias("n_star"))
    return Converted(moved, merge_conversions(leaves, delta), stars, counters)


def merge_conversions(leaves: DataFrame, delta: DataFrame) -> DataFrame:
    """``leaves`` (leaf, type_count, type_offset, flags) after ``delta`` (leaf, __k): so many gas rows of a leaf have become stars."""
    has_gas, has_star = LEAF_FLAGS["HasGas"], LEAF_FLAGS["HasStar"]
    met = leaves.join(delta, "leaf", "left")
    counts = f"transform(type_count, (c, t) -> if(t = {GAS}, c - __k, if(t = {STAR}, c + __k, c)))"
    offsets = f"transform(type_offset, (o, t) -> if(t > {GAS} and t <= {STAR}, o - __k, o))"
    flags = f"(flags | {has_star}) - if(type_count[{GAS}] = __k, flags & {has_gas}, 0)"
    new = [F.expr(f"if(__k is null, {c}, {e})").alias(c) for c, e in (("type_count", counts), ("type_offset", offsets), ("flags", flags))]
    kept = [c for c in leaves.columns if c not in ("type_count", "type_offset", "flags")]
    return met.select(*kept, *new).select(*leaves.columns)


def star_payload(n_star: int, count: int, like: DataFrame) -> DataFrame:
    """Zeroed payload rows for ``count`` new stars."""
    zero = [F.lit(0).cast(f.dataType).alias(f.name) for f in like.schema if f.name != "type_idx"]
    return like.sparkSession.range(n_star, n_star + count).select(F.col("id").alias("type_idx"), *zero).select(*like.columns)


def stage_gas_to_star(rows: DataFrame, requests: DataFrame, n_star: int, star_capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Mark gas rows as about to become stars, any number in any leaves at once.

    ``rows``: slot, leaf, ptype, flags, gas_idx, in type order within a leaf. ``requests``: seq, leaf, j: the
    j-th unstaged gas row of the leaf as it is when the requests of smaller seq are done. Such a row changes places with
    the last unstaged gas row of its leaf, payload and all, and gets the staged bit and the flag of a pending
    change. Returns the rows and (seq, star): the new star's index, from n_star on in the order of seq, or -1
    where there is no such row or no room. Only rows that requests concern move; leaves
    are worked on side by side.
    """
    gas = rows.filter(F.col("ptype") == GAS).groupBy("leaf").agg(F.min("slot").alias("first"), F.count("*").alias("n"))
    asked = requests.select("seq", "leaf", "j").join(gas, "leaf", "left")
    room = 2**62 if star_capacity is None else max(0, star_capacity - n_star)

    def fit(requests: list[tuple]) -> Iterator[tuple]:
        left = requests[0][3] or 0
        for _, seq, j, _, _ in requests:
            fits = j is not None and 0 <= j < left
            left -= fits
            yield seq, fits

    fits = written(_leaf_by_leaf(asked, fit, pa.schema([("seq", pa.int64()), ("fits", pa.bool_())])))
    numbered = ranked(fits.filter("fits"), "seq", [], "place").withColumn("ok", F.col("place") < room)
    stars = requests.select("seq").join(numbered.select("seq", F.expr(f"if(ok, place + {n_star}L, -1L)").alias("star")), "seq", "left").na.fill(-1, ["star"])
    taken = asked.join(numbered.filter("ok").select("seq"), "seq", "left_semi")

    def swap(requests: list[tuple]) -> Iterator[tuple]:
        n, first = requests[0][3:]
        at: dict[int, int] = {}  # which row stands in a place of the leaf's gas, where it may be another
        for k, (_, _, j, _, _) in enumerate(requests):
            last = n - 1 - k
            at[j], at[last] = at.get(last, last), at.get(j, j)
        for now, was in at.items():
            if was != now or now >= n - len(requests):
                yield first + was, first + now, now >= n - len(requests)

    moves = written(_leaf_by_leaf(taken, swap, pa.schema([("old_slot", pa.int64()), ("new_slot", pa.int64()), ("staged", pa.bool_())])))
    kept = rows.select("slot", F.col("gas_idx").alias("__idx")).withColumnRenamed("slot", "__slot")
    moved = rows.join(moves, F.col("slot") == F.col("old_slot"), "left").join(kept, F.col("new_slot") == F.col("__slot"), "left")
    staged, flag = F.coalesce("staged", F.lit(False)), PARTICLE_FLAGS["PendingMutation"]
    out = moved.withColumn("ptype", F.when(staged, F.col("ptype").bitwiseOR(F.lit(STAGED))).otherwise(F.col("ptype")).cast(rows.schema["ptype"].dataType))
    out = out.withColumn("flags", F.when(staged, F.col("flags").bitwiseOR(F.lit(flag))).otherwise(F.col("flags")).cast(rows.schema["flags"].dataType))
    # payload moves with the row: a place keeps its index
    out = out.withColumn("gas_idx", F.when(F.col("new_slot").isNotNull(), F.col("__idx")).otherwise(F.col("gas_idx"))).withColumn("slot", F.coalesce("new_slot", "slot"))
    return out.select(*rows.columns), stars


def integrate_staged(rows: DataFrame) -> DataFrame:
    """Extension: staged gas rows become stars, at the end of their leaf's stars; the flag goes."""
    staged = (F.col("ptype").bitwiseAND(F.lit(STAGED)) != 0) & (F.expr("ptype & 127") == GAS)
    pending = PARTICLE_FLAGS["PendingMutation"]
    out = rows.withColumn("__was", staged).withColumn("flags", F.when(staged, F.expr(f"flags - (flags & {pending})")).otherwise(F.col("flags")))
    out = out.withColumn("ptype", F.when(F.col("__was"), STAR).otherwise(F.col("ptype")))
    first = F.min("slot").over(Window.partitionBy("leaf"))
    order = Window.partitionBy("leaf").orderBy("ptype", F.col("__was").cast("int"), "slot")
    return out.withColumn("__first", first).withColumn("slot", F.col("__first") + F.row_number().over(order) - 1).select(*rows.columns)


def orphans(layout: Layout, name: str) -> DataFrame:
    """Payload rows that no common row refers to."""
    live = layout.common.filter(F.expr("ptype & 127") == PAYLOADS[name][0]).select("type_idx").distinct()
    return layout.typed[name].join(live, "type_idx", "left_anti")


def compact(layout: Layout) -> tuple[Layout, DataFrame]:
    """Drop payload without a common row, close the gaps in order, and renew the indices; also returns (grp, before, after).

    All tables' indices are settled in one pass and joined to the common rows once.
    """
    name = "case ptype & 127 " + " ".join(f"when {t} then '{k}'" for k, (t, _) in PAYLOADS.items()) + " end"
    held = None
    for grp, payload in layout.typed.items():
        part = payload.select(F.lit(grp).alias("__grp"), F.col("type_idx").alias("__old"))
        held = part if held is None else held.unionByName(part)
    live = layout.common.select(F.expr(name).alias("__grp"), F.col("type_idx").alias("__old")).filter("__grp is not null").distinct()
    moves = ranked(held.join(live, ["__grp", "__old"], "left_semi"), "__old", [], "__new", within="__grp").cache()
    common = layout.common.withColumn("__of", F.expr(name)).join(moves.withColumnRenamed("__grp", "__g"), F.expr("__of = __g and type_idx = __old"), "left")
    common = common.withColumn("type_idx", F.coalesce("__new", "type_idx")).select(*layout.common.columns)
    typed = {}
    for grp, payload in layout.typed.items():
        own = moves.filter(F.col("__grp") == grp).select("__old", "__new")
        typed[grp] = payload.join(own, F.col("type_idx") == F.col("__old")).withColumn("type_idx", F.col("__new")).select(*payload.columns)
    both = held.select("__grp", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(moves.select("__grp", F.lit(0).alias("b"), F.lit(1).alias("a")))
    names = layout.common.sparkSession.createDataFrame([(k,) for k in layout.typed], "grp string")
    counts = both.groupBy("__grp").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    return replace(layout, common=common, typed=typed), names.join(counts, F.col("grp") == F.col("__grp"), "left").select("grp", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before", "after")])
