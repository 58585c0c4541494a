"""Four ways to connect common rows with the payload of their type.

A: a directory of slots over whole-row tables by type. B (fine) and Bc (coarse):
common rows hold the index of their payload. C: payload lies in the order of the
common rows, so its index is the rank within the type.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .order import gather, ranked, swap_rows

#: Table of each payload, its type and its fields as SQL over the slot at which a row was filled in.
PAYLOADS = {
    "gas": (0, {"density": "slot * 1e-4D", "metals0": "cast(slot % 1000 as double)"}),
    "star": (4, {"stellar_age": "slot * 1e-5D"}),
    "bh": (5, {"bh_mass": "slot * 1e-6D"}),
}
COMMON = {"vel_x": "slot * 1e-3D", "ti_current": "slot"}


@dataclass(frozen=True)
class Layout:
    kind: str
    common: DataFrame
    typed: dict[str, DataFrame]


def with_group(rows: DataFrame) -> DataFrame:
    """``grp``: the table that a type's payload is in; the three kinds of dark matter share one."""
    return rows.withColumn("grp", F.expr("case when ptype = 0 then 'gas' when ptype in (1, 2, 3) then 'dm' when ptype = 4 then 'star' else 'bh' end"))


def with_type_index(rows: DataFrame, out: str = "type_idx", by_type: bool = False, n: int | None = None) -> DataFrame:
    """``out``: how many rows of the group (or the very type) come before, by slot. ``n``: how many rows there are, if known."""
    if by_type:
        return ranked(rows, "slot", [], out, within="ptype", n=n)
    return ranked(with_group(rows), "slot", [], out, within="grp", n=n).drop("grp")


def fill(kind: str, rows: DataFrame) -> Layout:
    """Lay out rows (slot, id, key, ptype, ...) with payload in the order in which they come.

    All tables of the layout are cut from the indexed rows, which are written to the shared folder.
    """
    indexed = written(with_type_index(rows))
    typed = {name: indexed.filter(F.col("ptype") == t).select("type_idx", F.col("id").alias("owner"), *[F.expr(e).alias(c) for c, e in fields.items()]) for name, (t, fields) in PAYLOADS.items()}
    common = indexed.select("*", *[F.expr(e).alias(c) for c, e in COMMON.items()])
    if kind == "A":  # whole rows by group; the directory has slot, group and index only
        whole = {g: with_group(common).filter(F.col("grp") == g).drop("slot", "grp") for g in ("gas", "dm", "star", "bh")}
        for name, payload in typed.items():
            whole[name] = whole[name].join(payload.drop("owner"), "type_idx")
        return Layout(kind, with_group(indexed).select("slot", "grp", "type_idx"), whole)
    return Layout(kind, common.drop("type_idx") if kind == "C" else common, typed)


def logical(layout: Layout) -> DataFrame:
    """The rows as any layout means them: slot, id, key, ptype, common and payload fields, null where a type has none."""
    fields = [c for _, f in PAYLOADS.values() for c in f]
    if layout.kind == "A":
        parts = []
        for g, whole in layout.typed.items():
            rows = layout.common.filter(F.col("grp") == g).join(whole, "type_idx")
            parts.append(rows.select("slot", "id", "key", "ptype", *COMMON, *[F.col(c) if c in whole.columns else F.lit(None).cast("double").alias(c) for c in fields]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    rows = layout.common if "type_idx" in layout.common.columns else with_type_index(layout.common)
    for name, payload in layout.typed.items():
        t = PAYLOADS[name][0]
        own = payload.drop("owner").withColumnRenamed("type_idx", "__own")
        rows = rows.join(own, F.expr(f"(ptype & 127) = {t} and type_idx = __own"), "left").drop("__own")
    return rows.select("slot", "id", "key", "ptype", *COMMON, *fields)


def with_payload(layout: Layout, name: str) -> DataFrame:
    """The rows of one type with the fields of its payload, found as the layout connects them.

    B and Bc: by the index that a common row holds. C: by position, the rank of a row among its type. A: by the
    directory's entry, into whole rows. A staged row's payload is that of its bare type.
    """
    t, fields = PAYLOADS[name]
    if layout.kind == "A":
        return layout.common.filter(F.col("grp") == name).join(layout.typed[name], "type_idx").drop("grp", "type_idx")
    common = layout.common if "type_idx" in layout.common.columns else with_type_index(layout.common)
    return common.filter(F.expr("ptype & 127") == t).join(layout.typed[name].drop("owner"), "type_idx").drop("type_idx")


def by_directory(layout: Layout) -> DataFrame:
    """Of layout A: every slot with its directory entry (grp, type_idx), and id, key and ptype from the whole row that it points to."""
    parts = [layout.common.filter(F.col("grp") == g).join(whole.select("type_idx", "id", "key", "ptype"), "type_idx") for g, whole in layout.typed.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("slot", "grp", "type_idx", "id", "key", "ptype")


def reshuffle(layout: Layout, perm: DataFrame) -> Layout:
    """Move a layout's rows by a permutation of slots.

    B and Bc move the common rows alone, whose indices stay good. A rewrites its
    directory and, as C, puts each payload into the new order.
    """
    if layout.kind in ("B", "Bc"):
        return replace(layout, common=gather(layout.common, perm))
    n = perm.count()  # once for all that is numbered
    if layout.kind == "A":
        moved = gather(layout.common, perm)
        new = ranked(moved.withColumnRenamed("type_idx", "old_idx"), "slot", [], "type_idx", within="grp", n=n)
        new = written(new)
        typed = {g: new.filter(F.col("grp") == g).select("old_idx", F.col("type_idx").alias("new_idx")).join(t.withColumnRenamed("type_idx", "old_idx"), "old_idx").withColumnRenamed("new_idx", "type_idx").drop("old_idx") for g, t in layout.typed.items()}
        return replace(layout, common=new.drop("old_idx"), typed=typed)
    both = written(with_type_index(gather(written(with_type_index(layout.common, "old_idx", n=n)), perm), n=n))
    typed = {}
    for name, payload in layout.typed.items():
        places = both.filter(F.expr("ptype & 127") == PAYLOADS[name][0]).select("old_idx", F.col("type_idx").alias("new_idx"))
        typed[name] = places.join(payload.withColumnRenamed("type_idx", "old_idx"), "old_idx").withColumnRenamed("new_idx", "type_idx").drop("old_idx")
    return replace(layout, common=both.drop("old_idx", "type_idx"), typed=typed)


def swap_same_type(layout: Layout, i: int, j: int) -> Layout:
    """Exchange two rows of one type, each layout in its way; what it means is the same."""
    if layout.kind in ("B", "Bc"):
        return replace(layout, common=swap_rows(layout.common, i, j))
    if layout.kind == "A":
        pair = layout.common.filter(F.col("slot").isin(i, j)).collect()
        if len({r["grp"] for r in pair}) != 1 or len(pair) != 2:
            raise ValueError("both rows must be of one type")
        g, (a, b) = pair[0]["grp"], (r["type_idx"] for r in pair)
        return replace(layout, typed=layout.typed | {g: swap_rows(layout.typed[g], a, b, "type_idx")})
    pair = {r["slot"]: r for r in with_type_index(layout.common).filter(F.col("slot").isin(i, j)).collect()}
    if len(pair) != 2 or pair[i]["ptype"] != pair[j]["ptype"]:
        raise ValueError("both rows must be of one type")
    typed = dict(layout.typed)
    for name, (t, _) in PAYLOADS.items():
        if t == pair[i]["ptype"]:
            typed[name] = swap_rows(typed[name], pair[i]["type_idx"], pair[j]["type_idx"], "type_idx")
    return replace(layout, common=swap_rows(layout.common, i, j), typed=typed)


def payload_violations(layout: Layout) -> DataFrame:
    """Common rows (slot) of a type with payload whose payload is missing or another's.

    The indexed rows are written once and read for each payload, for an order by itself for each would fill the plan.
    """
    common = layout.common if "type_idx" in layout.common.columns else with_type_index(layout.common)
    common = written(common.select("slot", "id", "type_idx", F.expr("ptype & 127").alias("kind")))
    out = None
    for name, payload in layout.typed.items():
        rows = common.filter(F.col("kind") == PAYLOADS[name][0]).drop("kind")
        bad = rows.join(payload.select("type_idx", "owner"), "type_idx", "left").filter("not (owner <=> id)").select("slot")
        out = bad if out is None else out.unionByName(bad)
    return out
