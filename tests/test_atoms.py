"""The registry of atoms: what is registered travels, what isn't doesn't exist."""

import pytest
from pyspark.sql import functions as F

from hilbertine.config import PRESETS
from hilbertine.functions.hilbert import with_hilbert_key
from hilbertine.operators import atoms, order
from hilbertine.schema import array_count
from hilbertine.sources.shared import new_folder, written

SPH = PRESETS["StandardSPH"]
SAID = ("common.id", "common.type", "common.vel", "gas.density", "gas.metals", "star.stellar_age", "bh.bh_mass")


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(120).selectExpr("id as slot", "1000 + id as id", "(id * 7919) % 2097152 as x", "(id * 104729) % 2097152 as y", "id as z", "cast(case when id % 40 = 0 then 5 when id % 10 = 1 then 4 when id % 2 = 0 then 0 else 1 + id % 3 end as int) as ptype")
    return written(with_hilbert_key(base))


def stored(kind, rows, config=SPH):
    registry = atoms.Atoms(config, kind)
    if config.has_hydro:
        registry.add("mark", "gas", "owner i8", {"owner": "id"})
    registry.add("halo", "common", "halo_id i8", {"halo_id": "id * 3"})
    return atoms.fill(registry, rows)


def said(store, *more):
    return sorted(map(str, atoms.read(store, *SAID, "gas.owner", "common.halo_id", *more).collect()))


def test_both_stores_mean_the_same_through_all_steps(spark, rows):
    perm = written(order.sort_permutation(rows))
    fine, coarse = (atoms.save(stored(k, rows), new_folder(spark, "atoms")) for k in ("B", "Bc"))
    assert said(fine) == said(coarse)
    moved = [atoms.swap(atoms.reorder(s, perm), 3, 4) for s in (fine, coarse)]
    assert said(moved[0]) == said(moved[1]) != said(fine)
    lost = []
    for s in moved:
        core = s.atoms.holder("common", "type").name
        kind = F.col(core)["type"]
        changed = atoms.with_field(s.table("common", core), core, "type", F.when((kind == 0) & (F.col("slot") % 3 == 0), 2).otherwise(kind))
        lost.append(s.put("common", changed, core))
    packed = [atoms.compact(s) for s in lost]
    assert said(packed[0][0], "common.type_idx") == said(packed[1][0], "common.type_idx")
    stats = {r.grp: (r.before, r.after) for r in packed[0][1].collect()}
    assert stats == {r.grp: (r.before, r.after) for r in packed[1][1].collect()} and stats["gas"][1] < stats["gas"][0] and stats["bh"] == (3, 3)
    gas = atoms.read(packed[0][0], "common.id", "common.type", "common.type_idx", "gas.owner", "gas.density").filter("type = 0").collect()
    assert all(r.owner == r.id for r in gas) and sorted(r.type_idx for r in gas) == list(range(len(gas)))


@pytest.mark.parametrize("kind", ["B", "Bc"])
def test_sent_and_received(spark, rows, kind):
    store = atoms.save(stored(kind, rows), new_folder(spark, "atoms"))
    message = atoms.pack(store, spark.range(20, 80).selectExpr("id as slot", "79 - id as seq"))  # backwards
    assert "linkage" not in message and all("type_idx" not in m.columns for m in message.values())
    back = atoms.unpack(store, message, 10, {"gas": 4, "star": 1, "bh": 1})
    got = atoms.read(back, "common.id", "common.type", "common.type_idx", "common.halo_id", "gas.owner", "gas.density").orderBy("slot").collect()
    assert [r.id for r in got] == [1000 + i for i in range(10)] + [1000 + i for i in range(79, 19, -1)] and all(r.halo_id == 3 * r.id for r in got)
    gas = [r for r in got[10:] if r.type == 0]
    assert [r.type_idx for r in gas] == [4 + k for k in range(len(gas))] and all(r.owner == r.id and r.density == pytest.approx((r.id - 1000) * 1e-4) for r in gas)
    assert all(r.type_idx == 0 for r in got[10:] if r.type in (1, 2, 3))


def test_reading_prunes_as_the_granularity_allows(spark, rows):
    """Of B only the tables of the atoms that are asked for are scanned, of Bc only their columns of one table."""
    folders = {k: new_folder(spark, "atoms") for k in ("B", "Bc")}
    plans = {}
    for k, folder in folders.items():
        store = atoms.save(stored(k, rows), folder)
        plans[k] = atoms.read(store, "common.key", "gas.density")._jdf.queryExecution().optimizedPlan().toString()
    assert plans["B"].count("Relation") == 3 and plans["Bc"].count("Relation") == 2  # core, linkage and gas_core; common and gas
    def scans(kind):
        frame = atoms.read(atoms.load(stored(kind, rows).atoms, spark, folders[kind]), "common.key", "gas.density")
        return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    text = scans("Bc")
    assert "struct<density:float>" in text and "gas_metal" not in text and "vel" not in text


def test_what_the_configuration_lacks_is_absent(spark, rows):
    store = stored("B", rows, PRESETS["GravityOnly"])
    assert set(store.tables) == {"core", "dyn", "time", "meta", "linkage", "halo"}
    with pytest.raises(KeyError):
        store.atoms.holder("common", "density")
    with pytest.raises(ValueError):
        store.atoms.add("mine", "gas", "x real")
    assert atoms.compact(store)[1].count() == 0
    got = atoms.read(atoms.swap(store, 0, 1), "common.id", "common.halo_id").orderBy("slot").first()
    assert (got.id, got.halo_id) == (1001, 3003)


def test_registry_refuses_what_it_knows():
    registry = atoms.Atoms(SPH, "B")
    assert len(registry.atoms) == array_count(SPH, "B")
    for name, group, fields in (("core", "common", "x real"), ("mine", "common", "mass real"), ("mine", "dm", "x real")):
        with pytest.raises(ValueError):
            registry.add(name, group, fields)
    for i in range(32 - len(registry.atoms)):
        registry.add(f"a{i}", "gas", f"f{i} wide*3")
    with pytest.raises(ValueError):
        registry.add("one_more", "gas", "g real")
    with pytest.raises(ValueError):
        atoms.Atoms(SPH, "C")
    sizes = {(name, group): (size, total) for name, group, size, total in atoms.Atoms(SPH, "Bc").report({"common": 10, "gas": 4})}
    assert sizes["gas", "gas"] == (256, 1024) and sizes["star", "star"] == (128, 0) and sizes["core", "common"] == (64, 640) and len(sizes) == array_count(SPH, "Bc")
