import numpy as np
import pytest
from pyspark.sql import functions as F

from hilbertine.functions import cubes
from hilbertine.functions.hilbert import hilbert_key_numpy, state_tables, with_hilbert_key

GOLDEN = {
    (0, 0, 0): 0, (1, 0, 0): 3, (0, 1, 0): 1, (0, 0, 1): 7, (1, 2, 3): 50, (2097151, 2097151, 2097151): 5929310595120927305,
    (2097151, 0, 0): 3623467585907233353, (1048576, 1048576, 1048576): 6464595579402677686, (123456, 654321, 1000000): 958456460474095025,
}


def test_golden_keys(spark):
    x, y, z = np.array(list(GOLDEN)).T
    assert hilbert_key_numpy(x, y, z).tolist() == list(GOLDEN.values())
    rows = with_hilbert_key(spark.createDataFrame(list(GOLDEN), "x long, y long, z long")).collect()
    assert {(r.x, r.y, r.z): r.key for r in rows} == GOLDEN


def test_states_are_permutations():
    follow, rank = state_tables()
    assert follow.shape == (24, 8) and (np.sort(rank, 1) == np.arange(8)).all() and sorted(set(follow.ravel())) == list(range(24))


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5])
def test_unit_steps(spark, bits):
    n = 1 << bits
    g = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_key_numpy(*g.T, bits)
    assert sorted(key) == list(range(n**3))
    assert (np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(1) == 1).all()
    got = with_hilbert_key(spark.createDataFrame([tuple(map(int, r)) for r in g], "x long, y long, z long"), bits=bits).select("key").collect()
    assert [r.key for r in got] == key.tolist()


def test_bits_are_held_in_range(spark):
    rows = spark.createDataFrame([(5, 6, 7)], "x long, y long, z long")
    assert with_hilbert_key(rows, bits=0).first().key == 0
    assert with_hilbert_key(rows, bits=30).first().key == with_hilbert_key(rows).first().key


def test_cubes(spark):
    rng = np.random.default_rng(1)
    keys = [0, 1, 7, 8, 2**63 - 1, *[int(k) for k in rng.integers(0, 2**63 - 1, 50)]]
    rows = spark.createDataFrame([(a, b) for a in keys for b in (a ^ 1, keys[3], a >> 9)], "a long, b long")
    for r in rows.select("a", "b", F.expr(cubes.common_level("a", "b")).alias("l")).collect():
        assert r.l == (21 if r.a == r.b else max(x for x in range(22) if r.a >> (63 - 3 * x) == r.b >> (63 - 3 * x)))
    assert cubes.bounds(32, 0.5) == (16, 48) and cubes.bounds(1, 1) == (1, 2) and cubes.bounds(10, 7) == (1, 20)
    assert cubes.level_for_side(2097152) == 0 and cubes.level_for_side(1024) == 11 and cubes.level_for_side(1) == 21


def test_key_takes_a_short_plan_and_small_methods(spark):
    """Plans with long tables fill the driver, and methods of 8,000 bytes and more stay uncompiled."""
    df = with_hilbert_key(spark.range(10).selectExpr("id", "id as x", "id * 2 as y", "id * 3 as z"))
    plan = df._jdf.queryExecution().executedPlan()
    assert len(plan.toString()) < 120_000
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(plan)
    assert made.size() and all(made.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(made.size()))
