"""What grows with the table: keys of large ids, and plans that must not."""

from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from hilbertine import queries
from hilbertine.config import PRESETS
from hilbertine.operators import exchange, layouts, leaves, mutate
from hilbertine.plans.maintenance import slotted
from hilbertine.sources.views import as_particles


def _orders(spark, first: int, n: int):
    return spark.range(first, first + n).selectExpr("id as o_orderkey", "id * 31 % 997 as o_custkey")


def test_interval_lookup_of_large_ids(spark, tmp_path):
    """From id 15,001 on the product is no bigint."""
    _orders(spark, 14_990, 40).write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.id: r.leaf for r in queries.queries()["j4_interval_lookup"](spark, str(tmp_path)).collect()}
    made = queries.leaves.build_leaves(queries._rows(spark, str(tmp_path)), queries.TARGET, queries.TOLERANCE).collect()
    for i in range(14_990, 15_030):
        key = i * 614891469123651 % 2**63
        assert found[i] == next((r.leaf for r in made if r.key_begin <= key <= r.key_last), None)


def test_ordered_and_laid_rows_are_scans(spark):
    """A cache upon a cache holds the plans of both, which fill the driver; keys are not computed again."""
    rows = slotted(as_particles(_orders(spark, 0, 300)))
    laid = layouts.reshuffle(layouts.fill("C", rows), rows.selectExpr("id as new_slot", "slot as old_slot"))
    for df in (rows, laid.common, laid.typed["gas"]):
        plan = df._jdf.queryExecution().toString()
        assert "InMemoryRelation" not in plan and "split(" not in plan and len(plan) < 20_000


def _no_call_per_leaf(*_, **__):
    raise AssertionError("a call by Spark for each leaf takes milliseconds a leaf")


def test_conversion_calls_nothing_per_leaf(spark, monkeypatch):
    """Leaves of three gas rows each: requests 0, 0 and 0 take them all, whatever task a leaf is in; a fourth is refused."""
    monkeypatch.setattr(GroupedData, "applyInPandas", _no_call_per_leaf)
    rows = spark.range(1500).selectExpr("id as slot", "id div 3 as leaf", "id", "0 as ptype", "id as type_idx")
    state = leaves.leaf_state(rows, rows.groupBy("leaf").agg(F.min("slot").alias("begin")))
    asked = spark.range(2000).selectExpr("id as seq", "id % 500 as leaf", "0L as j")
    got = mutate.convert_gas(rows, state, asked, 1500, 0)
    assert [r.star for r in got.stars.orderBy("seq").collect()] == list(range(1500)) + [-1] * 500
    assert [(r.id, r.ptype, r.type_idx) for r in got.rows.orderBy("slot").collect()] == [(3 * leaf + k, 4, 500 * k + leaf) for leaf in range(500) for k in (2, 1, 0)]


def test_staging_calls_nothing_per_leaf(spark, monkeypatch):
    monkeypatch.setattr(GroupedData, "applyInPandas", _no_call_per_leaf)
    rows = spark.range(1200).selectExpr("id as slot", "id div 3 as leaf", "id", "0 as ptype", "0 as flags", "id as gas_idx")
    asked = spark.range(1600).selectExpr("id as seq", "id % 400 as leaf", "0L as j")
    out, stars = mutate.stage_gas_to_star(rows, asked, 7)
    assert [r.star for r in stars.orderBy("seq").collect()] == list(range(7, 1207)) + [-1] * 400
    # the first goes to the last place; then what has come to the first place goes to the middle; then the rest stays
    assert [(r.id, r.ptype) for r in out.orderBy("slot").collect()] == [(3 * leaf + k, 128) for leaf in range(400) for k in (1, 2, 0)]


def test_payload_is_checked_on_written_rows(spark):
    """One order of the rows for all payloads; a missing and a foreign payload are found."""
    rows = slotted(as_particles(_orders(spark, 0, 300)))
    perm = rows.selectExpr("id as new_slot", "slot as old_slot")
    for kind in ("B", "C"):
        laid = layouts.reshuffle(layouts.fill(kind, rows), perm)
        good = layouts.payload_violations(laid)
        assert good.isEmpty() and "Window" not in good._jdf.queryExecution().executedPlan().toString()
        gas = laid.typed["gas"].filter("type_idx <> 3").withColumn("owner", F.expr("if(type_idx = 5, -1L, owner)"))
        bad = layouts.payload_violations(layouts.replace(laid, typed=laid.typed | {"gas": gas}))
        assert bad.count() == 2


def test_a_message_is_cut_from_written_rows(spark):
    """Chosen rows are found once, not again for each block and count."""
    rows = slotted(as_particles(_orders(spark, 0, 300)))
    laid = layouts.reshuffle(layouts.fill("Bc", rows), rows.selectExpr("id as new_slot", "slot as old_slot"))
    message = exchange.pack(laid, exchange.select_range(laid.common, 10, 200), PRESETS["StandardSPH"])
    assert "Join" not in message["common"]._jdf.queryExecution().toString() and message["common"].count() == 200
