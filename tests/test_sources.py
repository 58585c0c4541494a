import numpy as np
import pytest
from pyspark.sql import functions as F

from hilbertine.config import PRESETS, PhysicsConfig
from hilbertine.operators import exchange
from hilbertine.schema import array_count, record_bytes, schema_for
from hilbertine.sources import generate, random


def test_streams():
    s = random.stream(12345)
    want = [13720838825685603483, 2398916695208396998, 17770384849984869256]
    assert [next(s) for _ in range(3)] == want
    many = random.Streams(np.array([12345, 12345], np.uint64))
    assert [int(many.next()[1]) for _ in range(3)] == want


def test_positions(spark):
    rows = generate.generate_positions(spark, 4).orderBy("id").collect()
    assert [(r.x, r.y, r.z, r.key) for r in rows] == [
        (1700442, 1954348, 1803805, 6007788212617793307), (744843, 782958, 2036568, 8604685323851724501),
        (1464830, 1332668, 463077, 2402533219747744861), (2043669, 1200156, 981696, 3006700618663792551),
    ]
    rows = generate.generate_positions(spark, 2, clustered=True, temperature=0.05).orderBy("id").collect()
    assert [(r.x, r.y, r.z, r.key) for r in rows] == [(319661, 1436374, 1668176, 7972098099550275515), (757019, 425472, 1950687, 8684278829589790784)]


def test_types_and_permutations(spark):
    types = generate.types_exact(1000, 67890)
    assert types[:16].tolist() == [3, 0, 0, 2, 3, 1, 0, 3, 1, 0, 0, 3, 0, 3, 0, 0] and np.bincount(types, minlength=6).tolist() == [501, 164, 164, 166, 5, 0]
    assert all(types[i] == types[j] and i != j for i, j in generate.swap_pairs_exact(types, 200, 1))
    rows = spark.range(40).selectExpr("id as slot", "cast(if(id = 7, 5, id % 3) as int) as ptype")
    kind = {r.slot: r.ptype for r in rows.collect()}
    pairs = generate.swap_pairs(rows, 500).collect()
    assert sorted(r.seq for r in pairs) == list(range(500)) and all(kind[r.i] == kind[r.j] and r.i != r.j for r in pairs) and len({r.i for r in pairs}) == 39
    with pytest.raises(ValueError):
        generate.swap_pairs(rows.filter("slot < 3"), 5)
    perm = generate.sparse_permutation(rows, 0.3).collect()
    assert sorted(r.old_slot for r in perm) == sorted(r.new_slot for r in perm) == list(range(40)) and sum(r.old_slot != r.new_slot for r in perm) == 12
    drawn = generate.assign_types(spark.range(1000)).groupBy("ptype").agg(F.count("*").alias("n")).collect()
    assert {r.ptype: r.n for r in drawn} == {0: 501, 1: 164, 2: 164, 3: 166, 4: 5}


def test_counts():
    assert [tuple(generate.counts_from_total(n).values()) for n in (1, 20, 1000, 32768, 10**6)] == [(1, 0, 0, 0), (11, 9, 0, 0), (501, 494, 5, 0), (16386, 16216, 163, 3), (500000, 494900, 5000, 100)]


def test_schemas():
    assert {p: [array_count(c, k) for k in ("B", "C", "Bc")] for p, c in PRESETS.items()} == {"GravityOnly": [5, 4, 4], "StandardSPH": [15, 14, 7], "FullMHD": [19, 18, 7], "MFMHydro": [15, 14, 7]}
    assert set(schema_for(PRESETS["GravityOnly"])) == {"common"}
    assert schema_for(PRESETS["StandardSPH"])["gas"].fieldNames() == ["gas_core", "gas_grad", "gas_metal", "gas_sf"]
    assert exchange.exchange_sizes(PRESETS["StandardSPH"], {"common": 37, "gas": 10, "star": 5, "bh": 2})["tight_bytes"] == 11024
    assert record_bytes(PRESETS["FullMHD"])["legacy_fixed"] == 704
    for wrong in (PhysicsConfig(hydro_mfm=True), PhysicsConfig(star_formation=False), PhysicsConfig(n_metal_species=-1)):
        with pytest.raises(ValueError):
            schema_for(wrong)


def test_jumping_ahead_in_one_sequence():
    from itertools import islice

    import numpy as np

    from hilbertine.sources import random

    want = list(islice(random.stream(24680), 3000))
    steps = np.array([0, 1, 2, 63, 64, 1000, 2999, 5])
    assert [int(v) for v in random.jumped(24680, steps).next()] == [want[i] for i in steps]
    items = np.array([999, 0, 64, 63, 63, 500])
    assert random.drawn(24680, items, 3).tolist() == [want[3 * i : 3 * i + 3] for i in items]
    far = random.jumped(7, np.array([2**40 + 12345]))  # two leaps are as far as one
    again = random.jumped(7, np.array([2**40]))
    for _ in range(12345):
        again.next()
    assert int(far.next()[0]) == int(again.next()[0])


@pytest.mark.parametrize("parts", [1, 5])
def test_perturbed_rows_follow_the_one_sequence(spark, parts):
    from hilbertine.operators import partition
    from hilbertine.sources import random

    n, delta = 700, 256
    rows = spark.range(n).selectExpr("id as slot", "id * 31 as x", "2097151 - id as y", "id * 7 % 300 as z").repartition(parts)
    draws = random.stream(24680)
    places = {i: [i * 31, 2097151 - i, i * 7 % 300] for i in range(n)}
    for it in range(2):
        for i in range(n):
            places[i] = [min(max(v + next(draws) % (2 * delta + 1) - delta, 0), 2**21 - 1) for v in places[i]]
        rows = partition.perturb_in_order(rows, delta, n, it).select("slot", "x", "y", "z", "key")
        assert {r.slot: [r.x, r.y, r.z] for r in rows.collect()} == places
    still = partition.perturb_in_order(rows, 0, n)
    assert {r.slot: [r.x, r.y, r.z] for r in still.collect()} == places
