"""A hundred receivers at once, against messages made one by one."""

import pytest
from pyspark.sql import functions as F

from hilbertine.config import PRESETS
from hilbertine.functions.hilbert import with_hilbert_key
from hilbertine.operators import exchange, layouts, messages
from hilbertine.sources.shared import written

SPH = PRESETS["StandardSPH"]
BY = ("source", "dest")


@pytest.fixture(scope="module")
def laid(spark):
    base = spark.range(400).selectExpr("id as slot", "1000 + id as id", "(id * 7919) % 2097152 as x", "(id * 104729) % 2097152 as y", "id as z", "cast(case when id % 40 = 0 then 5 when id % 10 = 1 then 4 when id % 2 = 0 then 0 else 1 + id % 3 end as int) as ptype")
    return layouts.fill("Bc", written(with_hilbert_key(base)))


@pytest.fixture(scope="module")
def packed(spark, laid):
    """400 rows to a hundred receivers from three senders; a quarter of all rows is one message."""
    chosen = laid.common.withColumn("source", F.expr("cast(if(slot < 100, 0, slot % 3) as int)")).withColumn("dest", F.expr("cast(if(slot < 100, 7, slot * 31 % 100) as int)"))
    return written(chosen), messages.pack_messages(laid, written(chosen), SPH, BY)


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_against_single_messages(spark, laid, packed):
    chosen, got = packed
    raw = messages.message_bytes(got, SPH).cache()
    for source, dest in ((0, 7), (1, 31)):
        own = chosen.filter(f"source = {source} and dest = {dest}").drop(*BY)
        n = own.count()
        seq = {r.slot: k for k, r in enumerate(sorted(own.select("slot").collect()))}
        places = spark.createDataFrame(list(seq.items()), "slot long, seq long")
        one = exchange.to_buffer(exchange.pack(laid, own.join(places, "slot"), SPH), SPH)
        want, have = {r.offset: bytes(r.bytes) for r in one.collect()}, {r.offset: bytes(r.bytes) for r in raw.filter(f"source = {source} and dest = {dest}").collect()}
        assert n and want.keys() == have.keys() and want[0] == have[0]
        assert sorted(map(len, want.values())) == sorted(map(len, have.values()))


def test_bytes_and_back(spark, packed):
    _, sent = packed
    raw = written(messages.message_bytes(sent, SPH))
    for key, parts in {(k.source, k.dest): raw.filter(f"source = {k.source} and dest = {k.dest}").orderBy("offset").collect() for k in sent.headers.filter("dest in (7, 31)").collect()}.items():
        at = 0
        for p in parts:  # gapless
            assert p.offset == at
            at += len(p.bytes)
        assert at == sent.headers.filter(f"source = {key[0]} and dest = {key[1]}").first().total_bytes
    like = {b: type(rows.schema)([f for f in rows.schema if f.name not in (*BY, "place", "offset")]) for b, rows in sent.blocks.items()}
    back = messages.read_messages(raw, BY, like, SPH)
    assert plain(back.headers, *BY, *messages.HEADER) == plain(sent.headers, *BY, *messages.HEADER) and sent.headers.count() > 100
    for b, rows in sent.blocks.items():
        columns = [c for c in rows.columns]
        assert plain(back.blocks[b], *columns) == plain(rows, *columns)


@pytest.mark.parametrize("fault", ["magic", "count", "cut", "headless"])
def test_broken_messages_are_named(spark, packed, fault):
    _, sent = packed
    raw = messages.message_bytes(sent, SPH).filter("dest in (7, 8)")
    here = (F.col("source") == 0) & (F.col("dest") == 7)
    head = here & (F.col("offset") == 0)
    if fault == "cut":
        raw = raw.filter(~here | (F.col("offset") < 5000))
    elif fault == "headless":
        raw = raw.filter(~head)
    else:
        at = 33 if fault == "magic" else 1
        raw = raw.withColumn("bytes", F.when(head, F.expr(f"overlay(bytes placing X'77' from {at} for 1)")).otherwise(F.col("bytes")))
    back = messages.read_messages(raw, BY, {}, SPH)
    with pytest.raises(Exception, match="message 0, 7"):
        back.headers.collect()


def test_received_behind_what_is_held(spark, laid, packed):
    chosen, sent = packed
    held = spark.createDataFrame([(7, 50, 20, 3, 1), (8, 5, 5, 0, 0)], "dest int, n_common long, n_gas long, n_star long, n_bh long")
    got = messages.receive(sent, "dest", held)
    rows = got["common"].orderBy("dest", "slot").collect()
    start = {7: (50, 20, 3, 1), 8: (5, 5, 0, 0)}
    now = {}
    for r in sorted(rows, key=lambda r: (r.dest, r.slot)):
        n = now.setdefault(r.dest, dict(zip(("common", 0, 4, 5), start.get(r.dest, (0, 0, 0, 0)), strict=True)))
        assert r.slot == n["common"] and r.type_idx == n.get(r.ptype, 0)
        n["common"] += 1
        if r.ptype in n:
            n[r.ptype] += 1
    assert sorted(r.id for r in rows) == sorted(r.id for r in chosen.select("id").collect())
    order = [(r.dest, r.source) for r in rows]
    assert order == sorted(order)  # messages of a receiver by their sender
    for block, t in (("gas", 0), ("star", 4), ("bh", 5)):  # the linkage leads to each row's own payload
        own = {(r.dest, r.type_idx): r.owner for r in got[block].collect()}
        assert own == {(r.dest, r.type_idx): r.id for r in rows if r.ptype == t}


def test_capacity_is_enforced_with_figures(spark, packed):
    _, sent = packed
    none = spark.createDataFrame([], "dest int, n_common long, n_gas long, n_star long, n_bh long")
    room = sent.headers.select("dest").distinct().selectExpr("dest", "if(dest = 7, 99L, 1000L) as n_common", "1000L as n_gas", "1000L as n_star", "1000L as n_bh")
    with pytest.raises(Exception, match="receiver 7 has room for 99 of common, not for"):
        messages.receive(sent, "dest", none, room)["common"].collect()
    enough = room.withColumn("n_common", F.lit(1000).cast("long"))
    assert messages.receive(sent, "dest", none, enough)["common"].count() == 400


def test_no_messages(spark, laid):
    chosen = laid.common.limit(0).withColumn("source", F.lit(0)).withColumn("dest", F.lit(1))
    got = messages.pack_messages(laid, chosen, SPH, BY)
    assert got.headers.count() == 0 and messages.message_bytes(got, SPH).count() == 0
