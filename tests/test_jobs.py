"""The jobs on copies of growing input, run again, and lost on their way."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hilbertine.config import PRESETS
from hilbertine.operators import layouts
from jobs import archive_documents, exchange_domains

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(first, n):
    return [(i, None if i % 7 == 0 else f"text {i} é" * (i % 5), [None, "", "en", "de", "en"][i % 5], "s" if i % 3 else None, i) for i in range(first, first + n)]


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    part = next(Path(f"{folder}-{name}").glob("part-*.parquet"))
    Path(folder).mkdir(exist_ok=True)
    shutil.copy(part, f"{folder}/{name}.parquet")


def archive(rows, batches):
    """Row by row: each kind's records in order, batch behind batch."""
    out, count, size = [], {}, {}
    for number, part in enumerate(batches):
        for doc_id, text, lang, source, _ in sorted(part, key=lambda r: (r[0] is not None, r[0] or 0)):
            kind, n = lang or "none", len((text or "").encode())
            out.append((doc_id, source, text, n, count.get(kind, 0), size.get(kind, 0), number, kind))
            count[kind], size[kind] = count.get(kind, 0) + 1, size.get(kind, 0) + n
    return sorted(out)


def held(df):
    return sorted(tuple(r) for r in df.select("doc_id", "source", "text", "n_bytes", "type_idx", "first_byte", "batch", "kind").collect())


def test_archive_takes_what_is_new(spark, tmp_path):
    into, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    batches = [documents(0, 20), documents(20, 15), documents(35, 1)]
    for k, part in enumerate(batches):
        put(spark, into, f"f{k}", part)
        got = held(archive_documents.run(spark, into, out, mark))
        assert got == archive(None, batches[: k + 1])
        assert held(archive_documents.run(spark, into, out, mark)) == got  # nothing is taken twice
    counts = {(r.kind, r.batch): (r.n, r.n_bytes) for r in spark.read.schema(archive_documents.COUNTS).parquet(f"{out}/counts").collect()}
    assert sum(n for n, _ in counts.values()) == 36 and ("en", 1) in counts


def test_archive_after_a_lost_run(spark, tmp_path):
    into, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    put(spark, into, "a", documents(0, 30))
    archive_documents.run(spark, into, out, mark)
    put(spark, into, "b", documents(30, 12))
    want = held(archive_documents.run(spark, into, out, mark))
    for f in Path(mark, "commits").glob("*1*"):  # the second batch was begun, but not known to have ended
        f.unlink()
    shutil.rmtree(next(Path(out, "records").glob("batch=1/kind=en")))  # nor was all of it written
    assert held(archive_documents.run(spark, into, out, mark)) == want


def test_archive_of_one_file_a_batch_and_of_nothing(spark, tmp_path):
    into, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    put(spark, into, "none", [])
    assert held(archive_documents.run(spark, into, out, mark)) == []
    for k in range(3):
        put(spark, into, f"f{k}", documents(10 * k, 10))
    got = archive_documents.run(spark, into, out, mark, {"files_per_batch": 1})
    by_kind = {}
    for r in got.orderBy("kind", "type_idx").collect():
        n, size = by_kind.get(r.kind, (0, 0))
        assert (r.type_idx, r.first_byte) == (n, size)
        by_kind[r.kind] = n + 1, size + r.n_bytes
    assert sum(n for n, _ in by_kind.values()) == 30 and got.select("batch").distinct().count() == 3


def test_archive_of_repeated_and_null_ids(spark, tmp_path):
    into = f"{tmp_path}/in"
    rows = [(1, "b", "en", "s", 1), (1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (None, "n", "en", None, 1), (None, None, "en", None, 1)]
    put(spark, into, "f", rows)
    got = archive_documents.run(spark, into, f"{tmp_path}/out", f"{tmp_path}/mark").orderBy("type_idx").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 1] and [r.type_idx for r in got] == list(range(5))


def test_archive_in_small_ranges(spark, tmp_path, monkeypatch):
    """A task gets so many records with their texts and no more, and the archive is the same."""
    put(spark, f"{tmp_path}/in", "a", documents(0, 300))
    want, most, deal = held(archive_documents.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")), [], archive_documents.ranked

    def spied(df, *args, **more):
        most.append(more["rows_per_range"])
        return deal(df, *args, **more)

    assert archive_documents.RANGE_ROWS <= 10_000
    monkeypatch.setattr(archive_documents, "RANGE_ROWS", 20)
    monkeypatch.setattr(archive_documents, "ranked", spied)
    assert held(archive_documents.run(spark, f"{tmp_path}/in", f"{tmp_path}/out2", f"{tmp_path}/mark2")) == want and most == [20]


@pytest.fixture
def orders(spark, tmp_path):
    spark.range(3000).selectExpr("id as o_orderkey", "id * 37 % 911 as o_custkey", "'x' as o_comment").write.parquet(f"{tmp_path}/orders")
    return f"{tmp_path}/orders"


def test_domains_are_whole_and_run_again_alike(spark, tmp_path, orders):
    out = f"{tmp_path}/out"
    first = [tuple(r) for r in exchange_domains.run(spark, orders, out, {"parts": 40}).orderBy("source", "dest", "offset").collect()]
    again = exchange_domains.run(spark, orders, out, {"parts": 40})
    assert [tuple(r) for r in again.orderBy("source", "dest", "offset").collect()] == first
    heads = spark.read.parquet(f"{out}/headers").collect()
    assert len(heads) > 200 and all(h.total_bytes == 80 + 192 * h.n_common + 256 * h.n_gas + 128 * h.n_star + 320 * h.n_bh for h in heads)
    size = {"common": 192, "gas": 256, "star": 128, "bh": 320}
    ends = {}
    for r in again.orderBy("source", "dest", "offset").collect():  # blocks are packed without gaps
        assert r.offset == ends.get((r.source, r.dest), 80)
        ends[r.source, r.dest] = r.offset + size[r.block]
    assert ends == {(h.source, h.dest): h.total_bytes for h in heads}
    moved = again.filter("block = 'common'")
    assert moved.count() == moved.select("id").distinct().count() and moved.filter("source = dest").count() == 0
    for block, t in (("gas", 0), ("star", 4), ("bh", 5)):
        ids = lambda df: sorted(r.id for r in df.select("id").collect())
        assert ids(again.filter(F.col("block") == block)) == ids(moved.filter(F.col("ptype") == t))
    fewer = exchange_domains.run(spark, orders, out, {"parts": 2})
    assert {r.dest for r in fewer.select("dest").distinct().collect()} == {0, 1}


def test_domains_of_nothing_and_of_other_physics(spark, tmp_path, orders):
    spark.read.parquet(orders).limit(0).write.parquet(f"{tmp_path}/none")
    with pytest.raises(Exception, match="physics is off"):
        exchange_domains.run(spark, orders, f"{tmp_path}/off", {"preset": "GravityOnly"})
    with pytest.raises(ValueError):
        exchange_domains.run(spark, orders, f"{tmp_path}/off", {"parts": 0})


def test_command_lines_read_their_configuration(monkeypatch, tmp_path, spark, orders):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"parts": 3}))
    exchange_domains.main([orders, f"{tmp_path}/d", "--config", str(config)])
    assert spark.read.parquet(f"{tmp_path}/d/headers").agg(F.max("dest")).first()[0] == 2
    into = f"{tmp_path}/in"
    put(spark, into, "a", documents(0, 9))
    archive_documents.main([into, f"{tmp_path}/a", f"{tmp_path}/mark"])
    assert spark.read.parquet(f"{tmp_path}/a/records").count() == 9
