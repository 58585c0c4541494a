import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hilbertine.llm import linking, ngram_join

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402

FOLD = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, t):
    sets = [shingles(x, n) for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= t * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz") * rng.randint(1, 9)
    base = [[word() for _ in range(rng.choice([2, 3, 4, 8, 20, 60, 120]))] for _ in range(n // 6)]
    hot = [word() for _ in range(14)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base[: max(1, len(base) // rng.choice([1, 1, 8]))]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            i = rng.randint(0, len(w))
            w[i : i + rng.choice([0, 1, 1])] = [word() for _ in range(rng.choice([0, 1, 1]))]
        if rng.random() < 0.4:
            i = rng.randint(0, len(w))
            w[i:i] = hot
        out.append(rng.choice([" ", "\n", " \t"]).join(w) if rng.random() < 0.9 else " ".join(w).upper())
    return out


@pytest.mark.parametrize(("seed", "n", "threshold", "chunk"), [(1, 4, 0.85, 200_000), (2, 5, 0.8, 300), (3, 4, 0.85, 100)])
def test_against_brute_force(spark, monkeypatch, seed, n, threshold, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", chunk)
    texts = corpus(seed, 420)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, texts).repartition(5), n, threshold).collect()}
    want = brute(texts, n, round(100 * threshold))
    assert got == want
    assert 30 < len({c for _, c in want.values()}) < 400


@pytest.mark.parametrize("hot", [0, 30])
def test_tokens_dealt_over_tasks_give_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SALTS", 5)
    texts = corpus(4, 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, texts).repartition(5), 4, 0.85).collect()}
    assert got == brute(texts, 4, 85)


def test_one_of_each_stays(spark):
    texts = ["a b c d e f g h", "A b c d e f g h", "", None, "other words are in this one here"]
    d = docs(spark, texts)
    kept = ngram_join.keep_one_of_each(d)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == d.columns


def test_rows_that_repeat_an_id_are_told_apart(spark):
    near, other = "a b c d e f g h i j k l", "wholly other words make up this text"
    rows = [(1, near, 0), (2, near.upper(), 1), (2, other, 2), (None, near, 3), (None, other + " too", 4), (5, other, 5), (1, near, 6)]
    d = spark.createDataFrame(rows, "doc_id int, text string, gone int").withColumn("drop_id", F.lit(1)).withColumn("doc", F.lit("x"))
    kept = ngram_join.keep_one_of_each(d)
    assert sorted(r.gone for r in kept.collect()) == [0, 2, 4, 6] and kept.columns == d.columns


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(600)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    root: dict[int, int] = {}

    def find(k):
        while root.get(k, k) != k:
            k = root[k]
        return k

    for x, y in pairs:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    want = {k: find(k) for pair in pairs if pair[0] != pair[1] for k in pair}
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    writes = []
    kept = linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df: writes.append(1) or kept(df))
    for most, rounds in ((linking.EDGES, False), (50, True)):  # all in one task; dealt over several
        writes.clear()
        monkeypatch.setattr(linking, "EDGES", most)
        got = linking.connected_components(edges).collect()
        assert {r.node: r.comp for r in got} == want and len(got) == len(want) and (len(writes) > 2) == rounds


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    ids = rng.sample(range(-500, 500), 300)
    pairs = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[100], ids[i]) for i in range(101, 200)] + [(ids[250], ids[250])]
    got = {r.node: r.comp for r in linking.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: min(ids[:100]) for x in ids[:100]} | {x: min(ids[100:200]) for x in ids[100:200]}


def test_edges(spark):
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(edges(spark), 5, 0.8).collect()), key=str)
    assert rows == sorted([(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (4, 3, 4), (5, 3, 4), (6, 1, 6)], key=str)
    assert ngram_join.jaccard_components(none(spark)).count() == 0


@pytest.mark.parametrize("t", [50, 80, 85, 97])
def test_no_size_in_a_group_needs_fewer_hits_than_opens_it(spark, t):
    least = lambda x, y: -(-t * (x + y) // (100 + t)) - -(-t * max(x, y) // 100) + 1
    cases = [(x, a, b) for x in range(5, 41) for a in range(-(-t * x // 100), x + 9) for b in range(a, 100 * x // t + 1)]
    got = spark.createDataFrame(cases, "x long, a long, b long").selectExpr("x", "a", "b", f"{ngram_join._least_hits_of_any('x', 'a', 'b', t)} as n").collect()
    assert [(r.x, r.a, r.b, r.n) for r in got] == [(x, a, b, min(least(x, y) for y in range(a, b + 1))) for x, a, b in cases]
    if t == 85:
        assert (24, 22, 27, 1) in {(r.x, r.a, r.b, r.n) for r in got} and min(least(24, 22), least(24, 27)) == 2


def test_many_small_families_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for f in range(300):
        base = [f"w{f}x{i}" for i in range(rng.randint(15, 33))]
        for v in range(rng.randint(5, 9)):
            w = list(base)
            for k in range(rng.randint(0, 2)):
                i = rng.randint(0, len(w))
                w[i : i + rng.randint(0, 1)] = [f"n{f}x{v}x{k}"] * rng.randint(0, 1)
            texts.append((f, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs(spark, [x for _, x in texts]), 4, 0.85).collect()}
    for f in range(300):
        at = [i for i, (g, _) in enumerate(texts) if g == f]
        want = brute([texts[i][1] for i in at], 4, 85)
        assert [got[i] for i in at] == [at[want[j][1]] for j in range(len(at))]
