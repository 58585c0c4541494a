import hashlib
import random
import re
import sys
from pathlib import Path

import pytest

from hilbertine.llm import decontamination as dec

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402

FOLD = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute(text, items, n):
    w = words(text)
    hit, found = set(), set()
    for item_id, t in items:
        b = words(t)
        k = min(n, len(b))
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for s in range(len(w) - k + 1):
            if tuple(w[s : s + k]) in windows:
                hit.update(range(s, s + k))
                found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(6)
    vocabulary = ["a", "B", "É", "c-d", "x1", "ſ", "İk", "longer", "K"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 6])))) for i in (3, 20, 100, 101, 7)] + [(8, None), (3, "repeated item id here")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(150)]
    texts += [" ".join(["pre"] * 3) + " " + (items[k][1] or "").upper() + ", post" for k in range(5)] * 3
    return texts, items


@pytest.mark.parametrize("bound", [100_000, 0])
def test_against_brute_force(spark, bound):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dec.find_contamination(docs(spark, texts), bench, 4, bound).collect()}
    assert got == {i: brute(t, items, 4) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bound", [100_000, 0])
def test_documents_and_spans(spark, bound):
    d = docs(spark, ["x one two three four y", "one two three", "clean text"])
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert sorted(r.doc_id for r in dec.drop_contaminated(d, bench, 4, bound).collect()) == [1, 2]
    assert [r.text for r in dec.cut_spans(d, bench, 4, bound).orderBy("doc_id").collect()] == ["x y", "one two three", "clean text"]
    assert dec.drop_contaminated(d, bench, 4, bound).columns == d.columns


def test_edges(spark):
    bench = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    rows = dec.find_contamination(edges(spark), bench, 5).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 5), (4, 5), (5, 5), (6, 0)]
    assert dec.find_contamination(none(spark), bench).count() == 0
    assert {r.n_hit for r in dec.find_contamination(edges(spark), bench.limit(0)).collect()} == {0}
