"""Layouts, exchange and changes of type, beyond what the SQL comparison covers."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hilbertine.config import PRESETS
from hilbertine.functions.hilbert import with_hilbert_key
from hilbertine.operators import arena, exchange, layouts, mutate, order, partition

SPH = PRESETS["StandardSPH"]


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(120).selectExpr("id as slot", "1000 + id as id", "(id * 7919) % 2097152 as x", "(id * 104729) % 2097152 as y", "id as z", "cast(case when id % 40 = 0 then 5 when id % 10 = 1 then 4 when id % 2 = 0 then 0 else 1 + id % 3 end as int) as ptype")
    return with_hilbert_key(base).cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_layouts_mean_the_same_through_a_reorder(spark, rows):
    perm = order.sort_permutation(rows)
    meant = [layouts.logical(layouts.reshuffle(layouts.fill(k, rows), perm)) for k in ("B", "Bc", "C", "A")]
    assert meant[0].count() == 120 and all(same(meant[0], m) for m in meant[1:])
    assert layouts.payload_violations(layouts.reshuffle(layouts.fill("C", rows), perm)).count() == 0
    broken = layouts.fill("B", rows)
    broken = layouts.Layout("B", order.swap_rows(broken.common, 0, 0).withColumn("type_idx", F.expr("if(slot = 2, type_idx + 1, type_idx)")), broken.typed)
    assert [r.slot for r in layouts.payload_violations(broken).collect()] == [2]


def test_toy_reorder(spark):
    toy = spark.createDataFrame([(0, 100, 1.0), (1, 90, 2.0), (2, 80, 3.0), (3, 70, 4.0), (4, 60, 5.0)], "slot long, key long, mass double")
    perm = order.sort_permutation(toy)
    assert [r.old_slot for r in perm.orderBy("new_slot").collect()] == [4, 3, 2, 1, 0]
    moved = order.apply_permutation(toy, perm)
    assert [r.mass for r in moved.orderBy("slot").collect()] == [5, 4, 3, 2, 1] and partition.order_violations(moved).count() == 0
    same_rows = order.apply_permutation(toy, toy.selectExpr("slot as new_slot", "slot as old_slot"))
    assert same(same_rows, toy)
    with pytest.raises(ValueError):
        order.reshuffle_all({"short": toy.limit(2)}, perm)


@pytest.mark.parametrize("per_range", [500_000, 17])
def test_ranks_do_not_depend_on_the_ranges(spark, rows, per_range):
    got = order.ranked(rows.repartition(7), "key", ["id"], "r", within="ptype", rows_per_range=per_range).collect()
    want = {}
    for r in sorted(got, key=lambda r: (r.ptype, r.key, r.id)):
        assert r.r == want.setdefault(r.ptype, 0)
        want[r.ptype] += 1


def test_message_round_trip(spark, rows):
    laid = layouts.fill("Bc", rows)
    message = exchange.pack(laid, exchange.select_range(laid.common, 20, 60), SPH)
    empty = layouts.Layout("Bc", laid.common.limit(0), {k: v.limit(0) for k, v in laid.typed.items()})
    back = exchange.unpack(empty, message, 0, {"gas": 0, "star": 0, "bh": 0})
    want = layouts.logical(laid).filter("slot between 20 and 79").withColumn("slot", F.col("slot") - 20)
    assert same(layouts.logical(back), want) and layouts.payload_violations(back).count() == 0
    with pytest.raises(ValueError):
        exchange.pack(laid, exchange.select_range(laid.common, 0, 10), PRESETS["GravityOnly"])
    with pytest.raises(ValueError):
        exchange.unpack(empty, message, 0, {"gas": 0, "star": 0, "bh": 0}, {"common": 10, "gas": 99, "star": 99, "bh": 99})


def test_changes_of_type_and_compaction(spark):
    leaf = spark.createDataFrame([(s, 100 + s, 0, t, i) for s, (t, i) in enumerate([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 0)])], "slot long, id long, leaf int, ptype int, type_idx long")
    new = mutate.mutate_gas_to_star(leaf, spark.createDataFrame([(101, 0)], "id long, seq int"), 1)
    assert [(r.id, r.ptype) for r in new.orderBy("slot").collect()] == [(100, 0), (102, 0), (103, 1), (104, 1), (105, 2), (106, 3), (101, 4), (107, 4), (108, 5)]
    two = mutate.mutate_gas_to_star(leaf, spark.createDataFrame([(101, 0), (100, 1)], "id long, seq int"), 1)
    assert [(r.id, r.type_idx) for r in two.filter("ptype = 4").orderBy("slot").collect()] == [(100, 2), (101, 1), (107, 0)]
    full = mutate.mutate_gas_to_star(leaf, spark.createDataFrame([(101, 0), (107, 1)], "id long, seq int"), 1, 1)
    assert same(full, leaf)
    toy = spark.createDataFrame([(100 + i, 0, 0, 0, i, float(i + 1)) for i in range(4)] + [(104, 0, 4, 0, None, 7.0)], "slot long, leaf int, ptype int, flags int, gas_idx long, mass double")
    ask = lambda *j: spark.createDataFrame([(k, 0, x) for k, x in enumerate(j)], "seq long, leaf int, j long")
    stars = lambda s: [r.star for r in s.orderBy("seq").collect()]
    staged, at = mutate.stage_gas_to_star(toy, ask(1), 1)
    got = staged.orderBy("slot").collect()
    assert stars(at) == [1] and [(r.mass, r.ptype, r.flags) for r in got] == [(1, 0, 0), (4, 0, 0), (3, 0, 0), (2, 128, 32), (7, 4, 0)] and [r.gas_idx for r in got[:4]] == [0, 1, 2, 3]
    assert stars(mutate.stage_gas_to_star(toy, ask(4), 1)[1]) == [-1] and stars(mutate.stage_gas_to_star(toy, ask(0), 1, 1)[1]) == [-1]
    assert [(r.mass, r.ptype) for r in mutate.integrate_staged(staged).orderBy("slot").collect()] == [(1, 0), (4, 0), (3, 0), (7, 4), (2, 4)]


def test_many_rows_staged_at_once_equal_one_after_the_other(spark):
    import random

    rng = random.Random(3)
    rows, requests = [], []
    for leaf in range(6):
        gas = rng.randint(0, 7)
        rows += [(100 * leaf + k, leaf, 0 if k < gas else 4, 0, 1000 + 100 * leaf + k if k < gas else None, f"{leaf}-{k}") for k in range(gas + 2)]
        requests += [(leaf, rng.randint(-1, 7)) for _ in range(5)]
    rng.shuffle(requests)
    table = spark.createDataFrame(rows, "slot long, leaf int, ptype int, flags int, gas_idx long, name string")
    for room in (None, 9):
        now, n, want = {r[0]: list(r) for r in rows}, 5, []
        for leaf, j in requests:
            unstaged = sorted(s for s, r in now.items() if r[1] == leaf and r[2] == 0)
            if not 0 <= j < len(unstaged) or (room is not None and n >= room):
                want.append(-1)
                continue
            here, last = unstaged[j], unstaged[-1]
            now[here][5], now[last][5] = now[last][5], now[here][5]
            now[last][2], now[last][3] = 128, 32
            want.append(n)
            n += 1
        got, stars = mutate.stage_gas_to_star(table, spark.createDataFrame([(k, leaf, j) for k, (leaf, j) in enumerate(requests)], "seq long, leaf int, j long"), 5, room)
        assert [r.star for r in stars.orderBy("seq").collect()] == want
        assert [tuple(r) for r in got.orderBy("slot").collect()] == [tuple(now[s]) for s in sorted(now)]


def test_bytes_of_a_message(spark, rows):
    laid = layouts.fill("Bc", rows)
    message = exchange.pack(laid, exchange.select_range(laid.common, 20, 60), SPH)
    buffer = exchange.to_buffer(message, SPH).cache()
    parts = buffer.orderBy("offset").collect()
    at = 0
    for p in parts:  # gapless
        assert p.offset == at
        at += len(p.bytes)
    n = {k: message[k].count() for k in message}
    assert at == exchange.exchange_sizes(SPH, n)["tight_bytes"] == exchange.read_header(buffer).first().total_bytes
    back = exchange.from_buffer(buffer, {k: v.schema for k, v in message.items()}, SPH)
    assert all(same(back[k], message[k].select(*back[k].columns)) for k in message)
    schemas = {k: v.schema for k, v in message.items()}
    cut = buffer.filter(F.col("offset") < parts[-1].offset)
    wrong = [bytearray(parts[0].bytes) for _ in range(3)]
    wrong[0][32] ^= 1  # magic
    wrong[1][36] ^= 1  # version
    wrong[2][0] ^= 1  # a count that its block contradicts
    rest = buffer.filter("offset > 0")
    bad = [cut, rest, *(rest.union(spark.createDataFrame([(0, w)], "offset long, bytes binary")) for w in wrong)]
    for b in bad:
        with pytest.raises(ValueError):
            exchange.from_buffer(b, schemas, SPH)


def test_registry_refuses_and_clears():
    r = order.Registry({f"a{i}": i + 1 for i in range(32)}, {"a31": 10})
    assert r.report() == {"size": 32, "max_elem_size": 32, "max_elem_bytes": 320}
    with pytest.raises(ValueError):
        r.add("more", 1, 1)
    r.clear()
    assert r.report() == {"size": 0, "max_elem_size": 0, "max_elem_bytes": 0}


@pytest.mark.parametrize("block", [3, 500_000])
def test_running_sums(spark, block):
    rows = spark.range(20).selectExpr("id", "id * id as v").repartition(4)
    got = order.running_sum(rows, "id", "v", "before", block).orderBy("id").collect()
    assert [r.before for r in got] == [sum(i * i for i in range(k)) for k in range(20)]


@pytest.mark.parametrize("most", [1, 5, 500_000])
def test_radix_order(spark, rows, most):
    got = order.radix_ranked(rows.select("id", "key").union(rows.selectExpr("id + 1000", "key")), "key", ["id"], "r", most=most).collect()
    assert [x.r for x in sorted(got, key=lambda x: (x.key, x.id))] == list(range(240))
    assert order.radix_ranked(rows.limit(0), "key", ["id"], "r").count() == 0


def test_arena_reuses_and_restores():
    a = arena.Arena(1024, 64)
    first, second = a.allocate(100), a.allocate(100)
    mark = a.checkpoint()
    a.push(200)
    assert (first, second, a.used) == (0, 128, 1024 - a.top + 200) and a.peak == a.used
    inner = a.checkpoint()
    a.push(64)
    a.restore(inner)
    assert a.top == inner
    a.restore(mark)
    assert a.top == 1024
    a.release(first, 100)
    assert a.allocate(64) == 0 and a.free == [(64, 36)]
    a.release(second, 100)
    # what was skipped to align the second block stays behind the first one
    assert a.reserved == 128 and a.free == [(64, 36)]
    with pytest.raises(MemoryError):
        a.allocate(5000)


def test_replay_against_a_map_of_bytes(spark):
    """Every step of random traces: no two live blocks share a byte, and the counters are those of the map."""
    import random

    rng = random.Random(4)
    steps = [(t, s, rng.choice(["alloc", "alloc", "free", "push", "mark", "back", "pop"]), rng.choice([0, 1, 63, 64, 65, 300])) for t in range(6) for s in range(60)]
    got = {(r.trace, r.step): r for r in arena.replay(spark.createDataFrame(steps, "trace long, step long, op string, bytes long"), 4096).collect()}
    for t in range(6):
        blocks, temporary, marks, peak = [], [], [], 0
        for _, s, op, n in [x for x in steps if x[0] == t]:
            r = got[t, s]
            if op == "alloc" and n and r.offset is not None:
                assert r.offset % 64 == 0 and all(r.offset + n <= a or b <= r.offset for a, b in [*blocks, *temporary])
                blocks.append((r.offset, r.offset + n))
            elif op == "free" and blocks:
                blocks.pop(0)
            elif op == "push" and n and r.offset is not None:
                top = temporary[-1][0] if temporary else 4096
                assert r.offset % 64 == 0 and r.offset == (top - n) // 64 * 64 and all(b <= r.offset for _, b in blocks)
                temporary.append((r.offset, top))
            elif op == "mark":
                marks.append(len(temporary))
            elif op == "back" and marks:
                del temporary[marks.pop() :]
            elif op == "pop":
                temporary, marks = [], []
            live = sum(b - a for a, b in blocks)
            used = live + (4096 - temporary[-1][0] if temporary else 0)
            peak = max(peak, used)
            assert (r.live, r.used, r.peak, r.remaining) == (live, used, peak, 4096 - used)


@pytest.mark.parametrize(("fill", "byte"), [("none", None), ("zero", 0), ("poison", 0xCD)])
def test_what_new_blocks_hold(fill, byte):
    a = arena.Arena(256, 64, fill)
    a.memory[:] = b"\x11" * 256
    at = a.allocate(10)
    assert bytes(a.memory[at : at + 10]) == (b"\x11" if byte is None else bytes([byte])) * 10
    top = a.push(5)
    assert bytes(a.memory[top : top + 5]) == (b"\x11" if byte is None else bytes([byte])) * 5


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fields_by_slot(spark, rows):
    from hilbertine.operators import fields

    updates = spark.createDataFrame([(3, 77, None), (5, None, 9), (500, 1, 1)], "slot long, id long, ptype int")
    got = {r.slot: r for r in fields.set_fields(rows, updates).collect()}
    assert len(got) == 120 and (got[3].id, got[3].ptype) == (77, None) and (got[5].id, got[5].ptype) == (None, 9) and got[4].id == 1004
    asked = spark.createDataFrame([(3,), (3,), (119,), (999,)], "slot long")
    assert sorted((r.slot, r.id) for r in fields.get_fields(rows, asked, "id").collect()) == [(3, 1003), (119, 1119)]


@pytest.mark.parametrize("kind", ["A", "B", "Bc", "C"])
def test_payload_by_each_connection(spark, rows, kind):
    laid = layouts.reshuffle(layouts.fill(kind, rows), order.sort_permutation(rows))
    got = layouts.with_payload(laid, "gas").collect()
    assert len(got) == rows.filter("ptype = 0").count() and all(r.density == pytest.approx((r.id - 1000) * 1e-4) for r in got)
    if kind == "A":
        entries = layouts.by_directory(laid).collect()
        assert sorted(r.slot for r in entries) == list(range(120)) and all(r.type_idx == sum(o.grp == r.grp and o.slot < r.slot for o in entries) for r in entries)
