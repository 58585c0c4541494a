"""Order where keys repeat, and what its plans cost."""

import random

import pytest
from pyspark.sql import functions as F

from hilbertine.operators import leaves, order, partition


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows have one key of 63 bits, and many others lie close to it."""
    rng = random.Random(11)
    key = 2**62 + 12345
    rows = [(i, key if i % 2 else key + rng.randrange(-3, 4) if i % 5 else rng.randrange(2**63), i % 3) for i in range(1200)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, key long, g int").repartition(5).cache()


@pytest.mark.parametrize("within", [None, "g"])
def test_one_key_on_half_of_the_rows(hot, within):
    got = order.ranked(hot, "key", ["id"], "r", within=within, rows_per_range=50).collect()
    want: dict = {}
    for r in sorted(got, key=lambda r: (r.key, r.id)):
        group = r.g if within else None
        assert r.r == want.get(group, 0)
        want[group] = r.r + 1
    assert sum(want.values()) == 1200


def test_a_hot_key_spreads_over_ranges(hot):
    cuts = order.range_cuts(hot, "key", 1200, 50, "id")
    sizes = [r["count"] for r in hot.groupBy(cuts.range_of("key", "id")).count().collect()]
    assert len(cuts) == 23 and len(sizes) == 24 and max(sizes) <= 150
    of_hot = hot.filter(f"key = {2**62 + 12345}").select(cuts.range_of("key", "id").alias("r")).distinct().count()
    assert of_hot >= 8
    assert len(order.range_cuts(hot, "key", 1200, 50)) < 23  # without a tie-break a key is one range


def test_ranges_are_searched_in_logarithmic_steps(spark):
    cuts = order.Cuts(tuple(range(-(2**63), 2**63, 2**54)))
    values = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**54 - 1, 2**54, 2**63 - 1, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(cuts.range_of("v")).collect()]
    assert got == [sum(c <= (v if v is not None else -(2**63)) for c in cuts.keys) for v in values]
    text = cuts.range_of("v")._jc.toString()
    assert text.count("lambdafunction") <= 2 and len(cuts) == 1024  # eleven steps through one table


def test_nulls_come_first(spark):
    rows = spark.createDataFrame([(k, t) for k in (None, 1 - 2**63, 0, 2**63 - 1) for t in (None, 1, 2, 3)], "k long, t long")
    got = order.ranked(rows, "k", ["t"], "r", rows_per_range=3).orderBy("r").collect()
    first = lambda v: (v is not None, v or 0)
    assert [(r.k, r.t) for r in got] == sorted(((r.k, r.t) for r in got), key=lambda x: (first(x[0]), first(x[1]))) and [r.r for r in got] == list(range(16))


@pytest.mark.parametrize("most", [1, 7, 300])
def test_histogram_tree_with_a_hot_key(hot, most):
    got = order.radix_ranked(hot, "key", ["id"], "r", most=most).collect()
    assert [(r.key, r.id) for r in sorted(got, key=lambda r: r.r)] == sorted((r.key, r.id) for r in got) and sorted(r.r for r in got) == list(range(1200))


def test_histogram_tree_has_no_lists(hot):
    plan = order.radix_ranked(hot, "key", ["id"], "r", most=100)._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" not in plan and "LocalRelation" not in plan


def test_rows_outside_all_leaves_spread(spark):
    """Far more rows have no leaf than one range holds."""
    keys = sorted(random.Random(1).randrange(2**30) for _ in range(40))
    made = leaves.build_leaves(spark.createDataFrame(list(enumerate(keys)), "slot long, key long"), 4).cache()
    rows = spark.createDataFrame([(i, keys[i % 40] if i < 80 else 2**61 + i, i % 2) for i in range(400)], "slot long, key long, ptype int")
    got = partition.dealt(rows, made).collect()
    where = lambda r: (r.leaf if r.leaf is not None else 10**9, r.ptype != 0, r.slot)
    assert [r.slot for r in sorted(got, key=lambda r: r.new_slot)] == [r.slot for r in sorted(got, key=where)] and sum(r.leaf is None for r in got) == 320
    buckets = spark.createDataFrame([(2**62, i) for i in range(1000)], "b long, slot long")
    cuts = order.range_cuts(buckets, "b", 1000, 100, "slot")
    assert buckets.groupBy(cuts.range_of("b", "slot")).count().agg(F.max("count")).first()[0] < 400


def test_running_sums_within_groups(spark):
    rows = spark.range(60).selectExpr("id div 3 as at", "cast(id % 3 as int) as g", "id as v")
    for block in (4, 500_000):
        got = {(r.g, r.at): r.before for r in order.running_sum(rows, "at", "v", "before", block, within=("g",)).collect()}
        assert got == {(g, i): sum(3 * k + g for k in range(i)) for g in range(3) for i in range(20)}
