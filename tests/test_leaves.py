import random

import pytest

from pyspark.sql import functions as F

from hilbertine.functions import cubes
from hilbertine.operators import leaves, partition
from hilbertine.plans import maintenance
from hilbertine.sources import generate


def common(a, b):
    return 21 if a == b else max(x for x in range(22) if a >> (63 - 3 * x) == b >> (63 - 3 * x))


def greedy(keys, target, tolerance, max_side):
    """Row by row: from the largest cube allowed, deeper until few enough rows share it."""
    _, most = cubes.bounds(target, tolerance)
    out, at, level_least = [], 0, 0
    while at < len(keys):
        last = min(at + target - 1, len(keys) - 1)
        level = max(cubes.level_for_side(max_side), common(keys[at], keys[last]), level_least)
        while True:
            shift = 63 - 3 * level
            end = next((i for i in range(at, len(keys)) if keys[i] >> shift != keys[at] >> shift), len(keys))
            if end - at <= most or level == 21:
                break
            level += 1
        out.append((at, end, level))
        level_least = common(keys[end - 1], keys[end]) + 1 if end < len(keys) else 0
        at = end
    return out


@pytest.mark.parametrize("seed", range(4))
def test_closed_form_equals_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    for _ in range(4):
        n = rng.randint(1, 300)
        spread = rng.choice([2**63 - 1, 2**40, 2**12, 60])
        keys = sorted(rng.randrange(spread) for _ in range(n))
        target, tolerance, side = rng.choice([1, 2, 8, 32]), rng.choice([0, 0.25, 0.5, 1]), rng.choice([1, 64, 4096, 2097152])
        rows = spark.createDataFrame(list(enumerate(keys)), "slot long, key long")
        want = greedy(keys, target, tolerance, side)
        for block in (500_000, 40):
            got = leaves.build_leaves(rows, target, tolerance, side, block).orderBy("leaf").collect()
            assert [(r.begin, r.end, r.level) for r in got] == want, (n, target, tolerance, side, block)
        assert leaves.coverage_violations(leaves.build_leaves(rows, target, tolerance, side), rows, side).count() == 0


@pytest.mark.parametrize(("n", "target", "side", "clustered", "heat", "want"), [
    (1000, 32, 2**21, False, 0.25, (64, 16, 48, 26, 0)), (20, 64, 2**21, True, 0.05, (1, 20, 20, 1, 0)), (1000, 32, 1024, False, 0.25, (1000, 1, 1, 1000, 0)),
])
def test_published_leaves(spark, n, target, side, clustered, heat, want):
    rows = maintenance.slotted(generate.generate_positions(spark, n, 12345, clustered, heat).drop("key"))
    got = leaves.build_leaves(rows, target, 0.5, side).collect()
    assert (len(got), sum(r.underfull for r in got), sum(r.overfull for r in got)) == (want[0], *want[3:])
    if n == 1000 and side == 2**21:
        assert [(r.begin, r.end, r.level, r.key_begin) for r in sorted(got)[:3]] == [(0, 12, 2, 0), (12, 30, 2, 144115188075855872), (30, 53, 2, 288230376151711744)]


def test_keys_outside_have_no_leaf(spark):
    rows = spark.createDataFrame([(0, 100), (1, 101)], "slot long, key long")
    made = leaves.build_leaves(rows, 1, 0, 1)
    keys = spark.createDataFrame([(100,), (101,), (102,), (2**62,)], "key long")
    assert [r.leaf for r in leaves.find_leaf(keys, made).orderBy("key").collect()] == [0, 1, None, None]


@pytest.mark.parametrize("few", [500_000, 0])
def test_both_ways_of_lookup(spark, few, monkeypatch):
    monkeypatch.setattr(leaves._find_by_ranges, "__defaults__", (7,))
    rng = random.Random(6)
    keys = sorted(rng.randrange(2**40) for _ in range(60))
    made = leaves.build_leaves(spark.createDataFrame(list(enumerate(keys)), "slot long, key long"), 4, 0.5).cache()
    asked = [*keys, *[rng.randrange(2**41) for _ in range(100)], 0, 2**63 - 1]
    got = leaves.find_leaf(spark.createDataFrame([(i, k, k % 7) for i, k in enumerate(asked)], "id long, key long, leaf_idx long"), made, broadcast_leaves=few).collect()
    cubes_ = [(r.key_begin, r.key_last, r.leaf) for r in made.collect()]
    assert len(got) == len(asked) and all(r.leaf == next((x for a, b, x in cubes_ if a <= r.key <= b), None) and r.leaf_idx == r.key % 7 for r in got)


def test_rounds_of_maintenance(spark):
    """As many rounds as one likes: positions are those of the moves alone, and rows lie by leaf, gas first."""
    base = spark.range(300).selectExpr("id", "id * 6007 % 2097152 as x", "id * 3001 % 2097152 as y", "id * 977 as z", "cast(id % 3 as int) as ptype")
    rows, ranges = maintenance.maintain(base, 4, 900, 16)
    want = base
    for i in range(4):
        want = partition.perturb(want, 900, i).select("id", "x", "y", "z", "ptype", "key")
    places = lambda df: sorted(map(tuple, df.select("id", "x", "y", "z", "key").collect()))
    assert places(rows) == places(want)
    made = leaves.build_leaves(maintenance.slotted(base), 16)
    assert partition.partition_violations(leaves.find_leaf(rows, made), ranges).count() == 0
    assert [r.slot for r in rows.orderBy("slot").collect()] == list(range(300))


def test_breaches_of_coverage_are_found(spark):
    rng = random.Random(7)
    keys = sorted(rng.randrange(2**63 - 1) for _ in range(200))
    rows = spark.createDataFrame(list(enumerate(keys)), "slot long, key long")
    made = leaves.build_leaves(rows, 8, 0.5).cache()
    found = lambda broken, side=2**21: {(r.what, r.leaf) for r in leaves.coverage_violations(broken, rows, side).collect()}
    assert found(made) == set()
    last = made.count() - 1
    change = lambda leaf, column, to: made.withColumn(column, F.expr(f"if(leaf = {leaf}, {to}, {column})"))
    assert found(change(3, "end", "end + 1")) == {("gap", 4)}
    assert {("gap", 3), ("key", 3)} <= found(change(3, "begin", "begin + 1"))
    assert ("gap", 5) in found(change(4, "key_last", "9223372036854775807"))
    assert found(change(last, "end", "end - 1")) == {("total", None), ("key", last)}
    missing = found(made.filter("leaf <> 2"))
    assert ("gap", 3) in missing and ("key", None) in missing
    assert {w for w, _ in found(made, 1)} == {"side"}


def test_breaches_of_the_partition_are_found(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 4), (4, None, 0)], "slot long, leaf long, ptype int")
    ranges = partition.updated_ranges(spark.createDataFrame([(0,), (1,)], "leaf long"), rows)
    found = lambda r: {(x.what, x.slot) for x in partition.partition_violations(r, ranges).collect()}
    moved = lambda **to: rows.withColumn("slot", F.expr("case slot " + " ".join(f"when {k[1:]} then {v}" for k, v in to.items()) + " else slot end"))
    assert found(rows) == set()
    assert found(moved(s0=1, s1=0)) == {("gas", 0), ("gas", 1)}
    assert {("range", 1), ("range", 2)} <= found(moved(s1=2, s2=1))
    assert {("outside", 3), ("range", 4)} <= found(moved(s3=4, s4=3))
