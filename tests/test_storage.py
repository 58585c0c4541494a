"""Stored rows: clustered by leaf, moved a few at a time, checked while they are written; the tree above the leaves."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hilbertine.functions.hilbert import with_hilbert_key
from hilbertine.operators import clustered, delta, leaves, order, partition, tree
from hilbertine.plans import checked
from hilbertine.sources.shared import written


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(900).selectExpr("id", "(id * 7919 + id div 3) % 2097152 as x", "(id * 104729) % 2097152 as y", "id * 11 as z", "cast(if(id % 2 = 0, 0, if(id % 31 = 1, 4, 1)) as int) as ptype")
    return written(order.ranked(with_hilbert_key(base), "key", ["id"], "slot"))


@pytest.fixture(scope="module")
def made(rows):
    return written(leaves.build_leaves(rows, 16))


@pytest.mark.parametrize("piece", [1_000_000, 7])
def test_kept_lookup_equals_the_whole_one(spark, rows, made, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(clustered, "PIECE", piece)
    kept = clustered.store(leaves.find_leaf(rows, made), made, f"{tmp_path}/kept", 4)
    outside = rows.limit(3).selectExpr("id", "x", "y", "z", "ptype", "key", "slot")
    moved = partition.perturb(kept.rows, 20_000)
    want = {r.id: r.leaf for r in leaves.find_leaf(moved, made).select("id", "leaf").collect()}
    got = {r.id: r.leaf for r in clustered.renewed(moved, kept).select("id", "leaf").collect()}
    assert got == want and len(got) == 900
    stay = clustered.stayers(moved, kept).groupBy("stays").count().collect()
    assert {r.stays for r in stay} == {True, False}
    assert set(clustered.renewed(moved, kept).columns) == {*outside.columns, "leaf"}
    kept.forget()
    again = clustered.opened(spark, f"{tmp_path}/kept", 4)
    assert again.rows.count() == 900 and {r.id: r.leaf for r in clustered.renewed(partition.perturb(again.rows, 20_000), again).select("id", "leaf").collect()} == want
    again.forget()


def test_kept_lookup_moves_no_rows(spark, rows, made, tmp_path):
    kept = clustered.store(leaves.find_leaf(rows, made), made, f"{tmp_path}/kept", 4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clustered.stayers(partition.perturb(kept.rows, 300), kept)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        counts = kept.rows.groupBy("home", "piece").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in counts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    some = sorted(r.key for r in rows.select("key").collect())[100:140]
    between = clustered.rows_between(kept, some[0], some[-1])
    assert sorted(r.key for r in between.select("key").collect()) == some
    assert f"GreaterThanOrEqual(key,{some[0]})" in between._jdf.queryExecution().executedPlan().toString()
    kept.forget()


def test_rows_outside_all_leaves_are_stored_and_found(spark, rows, made, tmp_path):
    far = rows.withColumn("leaf", F.lit(None).cast("long"))
    kept = clustered.store(far, made, f"{tmp_path}/far", 4)
    got = {r.id: r.leaf for r in clustered.renewed(kept.rows, kept).collect()}
    assert got == {r.id: r.leaf for r in leaves.find_leaf(rows, made).collect()}
    kept.forget()


def permutation(rng, n, k):
    chosen = rng.sample(range(n), k)
    return list(zip(chosen, chosen[1:] + chosen[:1], strict=True))


def test_moves_follow_the_changed_rows(spark, rows, tmp_path):
    rng = random.Random(2)
    now = {r.slot: r.id for r in rows.collect()}
    places = delta.begin(rows, f"{tmp_path}/p")
    size = lambda folder: sum(f.stat().st_size for f in Path(folder).glob("*.parquet"))
    whole, bases = size(places.base), []
    for k in (10, 30, 1, 90, 200, 20):
        perm = permutation(rng, 900, k) if k > 1 else [(5, 5)]
        places = delta.apply(places, spark.createDataFrame(perm, "new_slot long, old_slot long"))
        now |= {new: now[old] for new, old in perm}
        assert {r.slot: r.id for r in places.read().collect()} == now
        bases.append(places.base)
        if places.moves:
            assert size(places.moves) < whole / 4 and places.moved <= 40 + 90
    assert bases[0] == bases[3] and bases[4] != bases[3] == f"{tmp_path}/p/base-0" and bases[5] == bases[4]  # 200 rows more made it a quarter
    assert sorted(r.name for r in Path(f"{tmp_path}/p").glob("base-*")) == ["base-0", "base-5"]


def test_moves_that_undo_each_other_are_forgotten(spark, rows, tmp_path):
    perm = permutation(random.Random(3), 900, 50)
    there, back = (spark.createDataFrame(p, "new_slot long, old_slot long") for p in (perm, [(b, a) for a, b in perm]))
    places = delta.apply(delta.apply(delta.begin(rows, f"{tmp_path}/p"), there), back)
    assert places.moved == 0 and {r.slot: r.id for r in places.read().collect()} == {r.slot: r.id for r in rows.collect()}


@pytest.fixture(scope="module")
def dealt(rows, made):
    homes = written(partition.dealt(partition.perturb(rows, 3000), made).withColumn("slot", F.col("new_slot")).drop("new_slot"))
    return homes, written(partition.updated_ranges(made, homes).join(made.select("leaf", "key_begin", "key_last", "side_cells"), "leaf"))


def test_checks_in_passing(spark, dealt, tmp_path):
    homes, ranges = dealt
    seen = checked.write_checked(homes, ranges, f"{tmp_path}/w", {"common": 900, "gas": 450})
    assert seen["common"] == 900 == spark.read.parquet(f"{tmp_path}/w").count() and seen["gas"] == 450 and not any(v for k, v in seen.items() if k.startswith("wrong_"))


@pytest.mark.parametrize(("change", "what"), [
    ("slot + 1", {"rows", "wrong_range"}), ("if(slot = 3, 4, slot)", {"rows"}), ("if(slot in (0, 899), 899 - slot, slot)", {"wrong_range"}),
])
def test_breaches_have_figures(dealt, tmp_path, change, what):
    homes, ranges = dealt
    with pytest.raises(checked.Breach) as e:
        checked.write_checked(homes.withColumn("slot", F.expr(change)), ranges, f"{tmp_path}/w")
    assert what <= set(e.value.figures)


def test_other_breaches(dealt, tmp_path):
    homes, ranges = dealt
    broken = {
        "wrong_cube": (homes.withColumn("key", F.expr("if(leaf = 2, key_, key)".replace("key_", "9223372036854775807"))), ranges, {}), "wrong_gas": (homes.withColumn("ptype", F.expr("if(leaf = 2, 1, ptype)")), ranges, {}),
        "common_over": (homes, ranges, {"capacity": {"common": 899}}), "star_over": (homes, ranges, {"capacity": {"star": 1}}), "wrong_side": (homes, ranges, {"max_side": 1}),
    }
    for what, (rows, held, more) in broken.items():
        with pytest.raises(checked.Breach) as e:
            checked.write_checked(rows, held, f"{tmp_path}/w", **more)
        assert set(e.value.figures) == {what} and e.value.figures[what] > 0


def test_the_tree(spark, rows, made):
    weighed = leaves.find_leaf(rows, made).withColumn("mass", F.expr("id % 5 + 1"))
    nodes = {(r.level, r.prefix): r for r in tree.octree(weighed, made).collect()}
    root = nodes[0, 0]
    whole = weighed.agg(F.count("*"), F.sum("mass"), *[F.sum(F.col("mass") * F.col(c)) for c in "xyz"]).first()
    assert (root.n, root.mass) == tuple(whole[:2]) and [root.com_x, root.com_y, root.com_z] == [m / whole[1] for m in whole[2:]]
    assert (root.parent, root.centre_x, root.half_width) == (None, 2.0**20, 2.0**20)
    below = {}
    for (level, prefix), r in nodes.items():
        if level:
            assert r.parent == prefix >> 3
            p = nodes[level - 1, r.parent]
            assert r.half_width * 2 == p.half_width and all(abs(r[f"centre_{c}"] - p[f"centre_{c}"]) == r.half_width for c in "xyz")
            n, mass = below.get((level - 1, r.parent), (0, 0))
            below[level - 1, r.parent] = n + r.n, mass + r.mass
    assert all(r.is_leaf != (k in below) and (r.is_leaf or below[k] == (r.n, r.mass)) for k, r in nodes.items())
    for r in made.collect():
        assert nodes[r.level, r.key_begin >> (63 - 3 * r.level)].n == r.end - r.begin
