"""Conversion of gas against a loop that does one request after the other, as the layouts define it."""

import random

import pytest

from hilbertine.functions.flags import LEAF_FLAGS
from hilbertine.operators import leaves, mutate


def loop(rows, requests, n_gas, n_star, capacity, live):
    """rows: by leaf, lists of [id, type, type_idx] in the order of their slots, which begin at 100 times the leaf."""
    count = {leaf: [sum(r[1] == t for r in part) for t in range(6)] for leaf, part in rows.items()}
    flags = {leaf: sum(LEAF_FLAGS[f] for f, ok in (("HasGas", c[0]), ("HasDM", sum(c[1:4])), ("HasStar", c[4]), ("HasBH", c[5])) if ok) for leaf, c in count.items()}
    out = []
    for leaf, j in requests:
        if leaf not in rows or not 0 <= j < count[leaf][0] or n_star >= capacity:
            out.append(-1)
            continue
        row = rows[leaf].pop(j)
        row[1], row[2] = 4, n_star
        out.append(n_star)
        n_star += 1
        n_gas -= live
        count[leaf][0] -= 1
        count[leaf][4] += 1
        rows[leaf].insert(sum(count[leaf][:4]), row)
        if not count[leaf][0]:
            flags[leaf] &= ~LEAF_FLAGS["HasGas"]
        flags[leaf] |= LEAF_FLAGS["HasStar"]
    return out, count, flags, n_gas, n_star


@pytest.mark.parametrize(("seed", "room", "live"), [(0, 1000, True), (1, 9, False), (2, 0, True)])
def test_against_the_loop(spark, seed, room, live):
    rng = random.Random(seed)
    rows, idx = {}, 0
    for leaf in range(8):
        types = sorted(rng.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(rng.randint(0, 12)))
        rows[leaf] = [[1000 * leaf + k, t, idx + k] for k, t in enumerate(types)]
        idx += len(types)
    n_gas, n_star = (sum(r[1] == t for part in rows.values() for r in part) for t in (0, 4))
    requests = [(rng.randrange(9), rng.randint(-1, 8)) for _ in range(40)]
    table = spark.createDataFrame([(100 * leaf + k, leaf, r[0], r[1], r[2]) for leaf, part in rows.items() for k, r in enumerate(part)], "slot long, leaf long, id long, ptype int, type_idx long")
    state = leaves.leaf_state(table, spark.createDataFrame([(leaf, 100 * leaf) for leaf in range(8)], "leaf long, begin long"))
    asked = spark.createDataFrame([(s, leaf, j) for s, (leaf, j) in enumerate(requests)], "seq long, leaf long, j long")
    got = mutate.convert_gas(table, state, asked, n_gas, n_star, n_star + room, live)
    stars, count, flags, gas_left, stars_now = loop(rows, requests, n_gas, n_star, n_star + room, live)
    assert [r.star for r in got.stars.orderBy("seq").collect()] == stars and (max(stars) >= 0) == bool(room) and -1 in stars
    assert [tuple(r) for r in got.rows.select("slot", "id", "ptype", "type_idx").orderBy("slot").collect()] == [(100 * leaf + k, *r) for leaf, part in rows.items() for k, r in enumerate(part)]
    kept = {r.leaf: r for r in got.leaves.collect()}
    assert {k: list(r.type_count) for k, r in kept.items()} == count and {k: r.flags for k, r in kept.items()} == flags
    assert {k: list(r.type_offset) for k, r in kept.items()} == {leaf: [100 * leaf + sum(c[:t]) for t in range(6)] for leaf, c in count.items()}
    assert tuple(got.counters.first()) == (gas_left, stars_now)
    again = leaves.leaf_state(got.rows, spark.createDataFrame([(leaf, 100 * leaf) for leaf in range(8)], "leaf long, begin long"))
    assert {r.leaf: (list(r.type_count), list(r.type_offset), r.flags) for r in again.collect()} == {k: (list(r.type_count), list(r.type_offset), r.flags) for k, r in kept.items()}


def test_published_offsets(spark):
    types = [0] * 3 + [1] * 2 + [2, 3, 4, 5]
    table = spark.createDataFrame([(k, 0, k, t, 0) for k, t in enumerate(types)], "slot long, leaf long, id long, ptype int, type_idx long")
    state = leaves.leaf_state(table, spark.createDataFrame([(0, 0)], "leaf long, begin long"))
    first = state.first()
    assert (list(first.type_count), list(first.type_offset)) == ([3, 2, 1, 1, 1, 1], [0, 3, 5, 6, 7, 8])
    after = mutate.convert_gas(table, state, spark.createDataFrame([(0, 0, 1)], "seq long, leaf long, j long"), 3, 1).leaves.first()
    assert (list(after.type_count), list(after.type_offset)) == ([2, 2, 1, 1, 2, 1], [0, 2, 4, 5, 6, 8])


def test_refused_requests_use_up_nothing(spark):
    leaf = spark.createDataFrame([(s, 100 + s, 0, t, i) for s, (t, i) in enumerate([(0, 0), (0, 1), (1, 0), (4, 0)])], "slot long, id long, leaf int, ptype int, type_idx long")
    asked = spark.createDataFrame([(102, 0), (101, 1), (100, 2)], "id long, seq int")  # the first is dark matter
    got = mutate.mutate_gas_to_star(leaf, asked, 1, 2).orderBy("slot").collect()
    assert [(r.id, r.ptype, r.type_idx) for r in got] == [(100, 0, 0), (102, 1, 0), (101, 4, 1), (103, 4, 0)]
    got = mutate.mutate_gas_to_star(leaf, asked, 1).orderBy("slot").collect()
    assert [(r.id, r.ptype, r.type_idx) for r in got] == [(102, 1, 0), (100, 4, 2), (101, 4, 1), (103, 4, 0)]
