import random
import sys
import zlib
from collections import Counter
from pathlib import Path

from hilbertine.llm import sharding

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_sizes_are_near_equal_and_groups_stay_together(spark):
    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 400) + str(rng.randint(0, 300)) for _ in range(1500)] + ["hot " * 200] * 700
    rows = sharding.shard_documents(docs(spark, texts), 8).collect()
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    loads = check(rows, 8)
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 8
    where = {}
    for r in rows:
        if not texts[r.doc_id].startswith("hot"):
            assert where.setdefault(texts[r.doc_id], r.shard) == r.shard


def naive(sizes, shards, capacity):
    """Best-fit decreasing by looking through all shards for each item."""
    room, out = [capacity] * shards, {}
    for key, size in sorted(sizes.items(), key=lambda x: -x[1]):
        fits = [s for s in range(shards) if room[s] >= size]
        shard = min(fits, key=lambda s: (room[s], s)) if fits else max(range(shards), key=lambda s: (room[s], s))
        room[shard] -= size
        out[key] = shard
    return out


def test_placement_against_brute_force(spark, monkeypatch):
    """Groups of one size may change places, so shards are compared by the sizes of their groups."""
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    rng = random.Random(8)
    texts = [f"{i}".ljust(rng.choice([20, 21, 90, rng.randint(1, 3000)]), "x") for i in range(400)]
    texts += [t for t in texts[:60] for _ in range(rng.randint(1, 3))] + [""] * 150
    rng.shuffle(texts)
    sizes = {}
    for t in texts:
        sizes[t] = sizes.get(t, 0) + len(t) + 16
    placed = naive(sizes, 6, -(-sum(sizes.values()) // 6))
    rows = sharding.shard_documents(docs(spark, texts).repartition(5), 6).collect()
    where = {}
    for r in rows:
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert len(rows) == len(texts) and where.keys() == sizes.keys()
    assert sorted((s, sizes[t]) for t, s in where.items()) == sorted((s, sizes[t]) for t, s in placed.items())
    check(rows, 6)


def spread(runs, sizes):
    """(size, shard) of each group."""
    ends = {(size, first): None for size, first, _ in runs}
    firsts = {}
    for size, first in ends:
        firsts.setdefault(size, []).append(first)
    out = []
    for size, first, shard in runs:
        later = [f for f in firsts[size] if f > first]
        out += [(size, shard)] * ((min(later) if later else dict(sizes)[size]) - first)
    return sorted(out)


def test_runs_of_sizes_against_one_by_one():
    rng = random.Random(9)
    for shards in (1, 2, 40):
        for most in (12, 500):
            items = dict(enumerate(rng.randint(1, most) for _ in range(400)))
            sizes = list(Counter(items.values()).items())
            capacity = -(-sum(items.values()) // shards)
            want = sorted((items[k], s) for k, s in naive(items, shards, capacity).items())
            assert spread(sharding.best_fit_decreasing(sizes, shards, capacity), sizes) == want


def test_tightest_bin_first():
    assert sharding.best_fit_decreasing([(5, 1), (4, 1), (3, 2)], 2, 8) == [(5, 0, 0), (4, 0, 1), (3, 0, 0), (3, 1, 1)]


def test_one_size_for_all(spark):
    rows = sharding.shard_documents(docs(spark, [f"{i:04d}" for i in range(1000)]), 7).collect()
    loads = check(rows, 7)
    assert len(rows) == 1000 and max(loads) - min(loads) <= 20


def test_very_long_text(spark):
    rows = sharding.shard_documents(docs(spark, ["x" * 10_000_000, *(f"{i}" for i in range(200))]), 4).collect()
    loads = sorted(check(rows, 4))
    assert loads[-1] == 10_000_016 and loads[2] - loads[0] <= 40


def test_edges(spark):
    rows = sharding.shard_documents(edges(spark), 3).collect()
    assert len(rows) == 8 and {r.size for r in rows if r.doc_id in (1, 2)} == {16}
    check(rows, 3)
    assert sharding.shard_documents(none(spark), 3).count() == 0
