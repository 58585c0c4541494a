"""Particle storage driven by a registry of atoms: whatever is registered is filled, moved, sent and compacted along.

An atom is a group of fields of one group of rows: ``common`` (every row, by slot) or a type's payload (``gas``, ``star``, ``bh``, by
type_idx). The fine store B keeps a table for each atom, so that a step reads and moves the tables of the atoms that it needs. The
coarse store Bc keeps a table for each group, with its atoms as struct columns: a row moves once, and scans prune
within structs. Both mean the same; neither names an atom outside the registry.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BH, GAS, STAR, PhysicsConfig
from ..schema import ATOMS, LINE, common_atoms, parsed, size_of_fields, struct_of, typed_atoms
from ..sources.shared import written
from .layouts import with_type_index
from .order import REGISTRY_ARRAYS, gather, ranked, swap_rows

TYPES = {"gas": GAS, "star": STAR, "bh": BH}
#: What a field is filled with, as SQL over slot, id, key, ptype, x, y, z and type_idx; all others with zeros.
RULES = {
    "common": {"pos": "array(x, y, z)", "key": "key", "type": "ptype", "id": "id", "vel": "array(slot * 1e-3D, 0D, 0D)", "ti_current": "slot", "type_idx": "type_idx"},
    "gas": {"density": "slot * 1e-4D", "metals": "transform(sequence(1, {n}), i -> if(i = 1, cast(slot % 1000 as double), 0D))"},
    "star": {"stellar_age": "slot * 1e-5D"},
    "bh": {"bh_mass": "slot * 1e-6D"},
}


@dataclass(frozen=True)
class Atom:
    name: str
    group: str
    fields: tuple[tuple[str, str, int], ...]  # (name, kind, count)
    rules: tuple[tuple[str, str], ...] = ()

    @property
    def struct(self) -> T.StructType:
        """Its fields; padding has a size, but isn't stored."""
        return struct_of([f for f in self.fields if f[0] != "pad"])

    def value(self) -> Column:
        """The atom of a row that is filled in."""
        rules, parts = dict(self.rules), []
        counts = {name: n for name, _, n in self.fields}
        for f in self.struct:
            zero = f"array_repeat(0, {counts[f.name]})" if isinstance(f.dataType, T.ArrayType) else "0"
            parts.append(F.expr(rules.get(f.name, zero).replace("{n}", str(counts[f.name]))).cast(_cast(f.dataType)).alias(f.name))
        return F.struct(*parts).alias(self.name)


def _cast(kind: T.DataType) -> T.DataType:
    return T.ArrayType(kind.elementType) if isinstance(kind, T.ArrayType) else kind


class Atoms:
    """The registry: the atoms that a configuration has, and those that are added."""

    def __init__(self, config: PhysicsConfig, kind: str, precision: str = "mixed") -> None:
        if kind not in ("B", "Bc"):
            raise ValueError("the store is B or Bc")
        self.config, self.kind, self.precision = config.checked(), kind, precision
        self.groups = ["common", *typed_atoms(config)]
        self.atoms: dict[str, Atom] = {}
        for group, names in {"common": common_atoms(config, kind), **typed_atoms(config)}.items():
            for name in names:
                self.add(name.removesuffix("_b"), group, ATOMS[name], RULES[group])

    def add(self, name: str, group: str, fields: str, rules: dict[str, str] | None = None) -> None:
        """Register an atom of ``fields``, written as in ``schema.ATOMS``; all operators carry it from now on."""
        if group not in self.groups:
            raise ValueError(f"the configuration has no {group}")
        if name in self.atoms or len(self.atoms) >= REGISTRY_ARRAYS:
            raise ValueError(f"{name} is known" if name in self.atoms else f"more than {REGISTRY_ARRAYS} arrays")
        listed = parsed(fields, self.config, self.precision)
        if twice := {f for a in self.of(group) for f, _, n in a.fields if n} & {f for f, _, n in listed if n and f != "pad"}:
            raise ValueError(f"{group} has {sorted(twice)} already")
        self.atoms[name] = Atom(name, group, tuple(listed), tuple((rules or {}).items()))

    def of(self, group: str) -> list[Atom]:
        return [a for a in self.atoms.values() if a.group == group]

    def holder(self, group: str, field: str) -> Atom:
        for a in self.of(group):
            if any(f == field and n for f, _, n in a.fields):
                return a
        raise KeyError(f"{group} has no field {field}")

    def report(self, rows: dict[str, int], align: int = LINE) -> list[tuple[str, str, int, int]]:
        """(array, group, bytes of an element, bytes in all): an array an atom in B, and for Bc's payload one a group."""
        out = []
        for group in self.groups:
            sizes = [(a.name, size_of_fields(list(a.fields), align)) for a in self.of(group)]
            if self.kind == "Bc" and group != "common":
                sizes = [(group, -(-sum(size_of_fields(list(a.fields), 32) for a in self.of(group)) // align) * align)]
            out += [(name, group, size, size * rows.get(group, 0)) for name, size in sizes]
        return out


@dataclass(frozen=True)
class Store:
    atoms: Atoms
    tables: dict[str, DataFrame]  # by atom in B, by group in Bc

    def table(self, group: str, *names: str) -> DataFrame:
        """Rows of a group with the atoms ``names``, or all: of B the tables of these alone are read, of Bc these columns."""
        chosen = [a.name for a in self.atoms.of(group) if not names or a.name in names]
        key = key_of(group)
        if self.atoms.kind == "Bc":
            return self.tables[group].select(key, *chosen)
        out = self.tables[chosen[0]]
        for name in chosen[1:]:
            out = out.join(self.tables[name], key)
        return out

    def put(self, group: str, rows: DataFrame, *names: str) -> Store:
        """The store with the atoms ``names``, or all, of a group from ``rows``, which has them under their key."""
        chosen = [a.name for a in self.atoms.of(group) if not names or a.name in names]
        key = key_of(group)
        if self.atoms.kind == "B":
            return replace(self, tables=self.tables | {name: rows.select(key, name) for name in chosen})
        rest = [a.name for a in self.atoms.of(group) if a.name not in chosen]
        whole = rows.select(key, *chosen) if not rest else self.tables[group].select(key, *rest).join(rows.select(key, *chosen), key)
        return replace(self, tables=self.tables | {group: whole.select(key, *[a.name for a in self.atoms.of(group)])})


def key_of(group: str) -> str:
    return "slot" if group == "common" else "type_idx"


def fill(atoms: Atoms, rows: DataFrame) -> Store:
    """A store of rows (slot, id, key, ptype, x, y, z), their payload in the order in which they come."""
    indexed = written(with_type_index(rows))
    store = Store(atoms, {})
    for group in atoms.groups:
        own = indexed if group == "common" else indexed.filter(F.col("ptype") == TYPES[group])
        # of equal keys and rows: a table's atoms need no join when they are filled
        values = {a.name: own.select(key_of(group), a.value()) for a in atoms.of(group)}
        if atoms.kind == "Bc":
            values = {group: own.select(key_of(group), *[a.value() for a in atoms.of(group)])}
        store = replace(store, tables=store.tables | values)
    return store


def save(store: Store, path: str) -> Store:
    """Every array written as Parquet into a folder of its own below ``path``, and the store that reads them: what came before is not done again."""
    for name, rows in store.tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return load(store.atoms, next(iter(store.tables.values())).sparkSession, path)


def load(atoms: Atoms, spark: SparkSession, path: str) -> Store:
    """The store that ``save`` has written."""
    names = atoms.groups if atoms.kind == "Bc" else list(atoms.atoms)
    return Store(atoms, {name: spark.read.parquet(f"{path}/{name}") for name in names})


def _each(store: Store, group: str, change) -> Store:
    """``change`` done to every table of a group."""
    names = [group] if store.atoms.kind == "Bc" else [a.name for a in store.atoms.of(group)]
    return replace(store, tables=store.tables | {n: change(store.tables[n]) for n in names})


def reorder(store: Store, perm: DataFrame) -> Store:
    """Every common atom moved by a permutation of slots; payload stays, and indices stay good."""
    return _each(store, "common", lambda t: gather(t, perm))


def swap(store: Store, i: int, j: int) -> Store:
    """Two rows of one type exchanged, with all their common atoms."""
    return _each(store, "common", lambda t: swap_rows(t, i, j))


def read(store: Store, *fields: str) -> DataFrame:
    """slot and ``group.field`` for each row, under the field's name; payload that a row's type doesn't have is null.

    Only the atoms that hold these fields are read, and those that link them: type and index.
    """
    by_group: dict[str, list[str]] = {}
    for f in fields:
        group, name = f.split(".")
        by_group.setdefault(group, []).append(name)
    needed = [*by_group.get("common", []), *(["type", "type_idx"] if set(by_group) - {"common"} else [])]
    rows = _flat(store, "common", list(dict.fromkeys(needed)))
    for group in [g for g in by_group if g != "common"]:
        own = _flat(store, group, by_group[group]).withColumnRenamed("type_idx", "__own")
        rows = rows.join(own, F.expr(f"(type & 127) = {TYPES[group]} and type_idx = __own"), "left").drop("__own")
    return rows.select("slot", *[f.split(".")[1] for f in fields])


def _flat(store: Store, group: str, names: list[str]) -> DataFrame:
    holders = {name: store.atoms.holder(group, name).name for name in names}
    return store.table(group, *holders.values()).select(key_of(group), *[F.col(f"{a}.{name}").alias(name) for name, a in holders.items()])


def with_field(rows: DataFrame, atom: str, field: str, value: Column) -> DataFrame:
    """``rows`` with a field of the struct ``atom`` replaced, cast to its type."""
    kind = next(f.dataType for f in rows.schema[atom].dataType if f.name == field)
    return rows.withColumn(atom, F.col(atom).withField(field, value.cast(_cast(kind))))


def compact(store: Store) -> tuple[Store, DataFrame]:
    """Payload without a common row goes, gaps close in order, indices are renewed: for every atom of every type. Also returns (grp, before, after)."""
    links = _flat(store, "common", ["type", "type_idx"])
    if not store.atoms.groups[1:]:
        return store, links.sparkSession.createDataFrame([], "grp string, before long, after long")
    name = "case type & 127 " + " ".join(f"when {t} then '{g}'" for g, t in TYPES.items() if g in store.atoms.groups) + " end"
    live = links.select(F.expr(name).alias("__grp"), F.col("type_idx").alias("__old")).filter("__grp is not null").distinct()
    held = None
    for group in store.atoms.groups[1:]:
        first = store.table(group, store.atoms.of(group)[0].name).select(F.lit(group).alias("__grp"), F.col("type_idx").alias("__old"))
        held = first if held is None else held.unionByName(first)
    moves = ranked(held.join(live, ["__grp", "__old"], "left_semi").withColumn("__old", F.col("__old").cast("long")), "__old", [], "__new", within="__grp").cache()
    holder = store.atoms.holder("common", "type_idx").name
    linked = store.table("common", holder, store.atoms.holder("common", "type").name).withColumn("__of", F.expr(f"case {store.atoms.holder('common', 'type').name}.type & 127 " + name.split("127 ", 1)[1]))
    linked = linked.join(moves.withColumnRenamed("__grp", "__g"), F.expr(f"__of = __g and {holder}.type_idx = __old"), "left")
    out = store.put("common", with_field(linked, holder, "type_idx", F.coalesce("__new", F.col(holder)["type_idx"])), holder)
    for group in store.atoms.groups[1:]:
        own = moves.filter(F.col("__grp") == group).select("__old", "__new")
        out = _each(out, group, lambda t, own=own: t.join(own, F.col("type_idx") == F.col("__old")).withColumn("type_idx", F.col("__new")).select(*t.columns))
    both = held.select("__grp", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(moves.select("__grp", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return out, both.groupBy(F.col("__grp").alias("grp")).agg(F.sum("b").cast("long").alias("before"), F.sum("a").cast("long").alias("after"))


def pack(store: Store, chosen: DataFrame) -> dict[str, DataFrame]:
    """A message of the rows ``chosen`` (slot, seq): every array by itself, but the linkage, by ``place``: seq, or that of payload in the order in which its rows come."""
    linkage = store.atoms.holder("common", "type_idx").name
    sent = chosen.select("slot", F.col("seq").alias("place"))
    links = _flat(store, "common", ["type", "type_idx"]).join(sent, "slot")
    out = {}
    for name, group in _arrays(store.atoms):
        if group == "common":
            table = store.tables[name]
            out[name] = table.drop(*[c for c in (linkage,) if c in table.columns]).join(sent, "slot").drop("slot")
    if linkage in out:  # of B: a table of its own, empty now but for its places
        del out[linkage]
    for group in store.atoms.groups[1:]:
        own = ranked(links.filter(F.expr(f"(type & 127) = {TYPES[group]}")).withColumnRenamed("place", "seq").select("seq", "type_idx"), "seq", [], "place").drop("seq").cache()
        for name, of in _arrays(store.atoms):
            if of == group:
                out[name] = own.join(store.tables[name], "type_idx").drop("type_idx")
    return out


def _arrays(atoms: Atoms) -> list[tuple[str, str]]:
    """(table, group) of a store's tables."""
    return [(g, g) for g in atoms.groups] if atoms.kind == "Bc" else [(a.name, a.group) for a in atoms.atoms.values()]


def unpack(store: Store, message: dict[str, DataFrame], at: int, n: dict[str, int]) -> Store:
    """A message put behind slot ``at`` and behind ``n`` payload rows of each group, with the linkage made anew from the types."""
    linkage, kind = store.atoms.holder("common", "type_idx"), store.atoms.holder("common", "type").name
    groups = store.atoms.groups[1:]
    types = message["common" if store.atoms.kind == "Bc" else kind].select("place", (F.col(kind)["type"].bitwiseAND(F.lit(127))).alias("__t"))
    nth = ranked(types, "place", [], "__nth", within="__t")
    start = F.expr("case __t " + " ".join(f"when {TYPES[g]} then {n.get(g, 0)} + __nth" for g in groups) + " else 0 end") if groups else F.lit(0)
    links = nth.select("place", F.struct(*[(start if f.name == "type_idx" else F.lit(0)).cast(f.dataType).alias(f.name) for f in linkage.struct]).alias(linkage.name))
    if store.atoms.kind == "Bc":
        message = message | {"common": message["common"].join(links, "place")}
    else:
        message = message | {linkage.name: links}
    tables = {}
    for name, group in _arrays(store.atoms):
        key, end = key_of(group), at if group == "common" else n.get(group, 0)
        new = message[name].withColumn(key, F.col("place") + end)
        tables[name] = store.tables[name].filter(F.col(key) < end).unionByName(new.select(*store.tables[name].columns))
    return replace(store, tables=tables)
