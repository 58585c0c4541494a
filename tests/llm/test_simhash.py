import random
import re
import sys
from pathlib import Path

import pytest
import xxhash

from hilbertine.llm import queries, simhash

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402

FOLD = {i: i + 32 for i in range(65, 91)}


def by_definition(text, n=3):
    """The contract word by word: a string of each shingle, a count of each bit."""
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "One TWO three", "a b c a b c a b c", "É x  y z\x0bq", "é" * 50 + " 𝄞 " + "w " * 40])
def test_fingerprint_by_definition(text):
    assert simhash.simhash((text or "").encode()) == signed(by_definition(text))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_fingerprints_of_random_texts(n, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)  # long texts are hashed in blocks
    rng = random.Random(n)
    for size in (1, 2, 5, 6, 7, 8, 40, 200):
        text = " ".join(rng.choice(["ab", "Cde", "f", "gh-i", "ü"]) for _ in range(size))
        assert simhash.simhash(text.encode(), n) == signed(by_definition(text, n))


def test_a_very_long_text():
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(10_000)) for _ in range(2_000_000))  # some 10^7 characters
    h = [xxhash.xxh64_intdigest(s, 42) for s in (" ".join(w) for w in zip(*[text.split()[i:] for i in range(3)], strict=False))]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(text.encode()) == signed(want)


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_pairs_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1, 1 << 63}
    for base in list(fps):
        for k in range(5):  # near ones, in every segment, the sign among them
            x = base
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(40, 52)}  # many in few entries of the tables
    fps = sorted(fps)
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance}
    rows = [(signed(x),) for x in [*fps, *fps[:9]]]
    got = [(min(r), max(r)) for r in simhash.near_pairs(spark.createDataFrame(rows, "fp long"), distance).collect()]
    assert len(got) == len(set(got)) and set(got) == want and bool(want) == bool(distance)


def test_no_other_distances(spark):
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \n", "One", "one"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 150]))]
        for k in range(6):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if k == 1 else " ".join(copy))
    texts += ["a copy of a hot text, again and again"] * 60
    rows = docs(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(rows).collect()}
    fps = [by_definition(t) for t in texts]
    want = components(list(range(len(texts))), fps, 2)
    assert got == {i: (f"{x:016x}", c) for i, (x, c) in enumerate(zip(fps, want, strict=True))}
    assert len(set(want)) < len(set(fps)) < len(texts)  # links beyond equal fingerprints are among them


def test_edges(spark):
    assert simhash.simhash_components(none(spark)).count() == 0
    rows = edges(spark)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_components(rows).collect())
    given = [(r.doc_id, by_definition(r.text)) for r in rows.collect()]
    want = components([i for i, _ in given], [x for _, x in given], 2)
    assert got == sorted((i or -1, f"{x:016x}", c) for (i, x), c in zip(given, want, strict=True))
    assert {(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1)} <= set(got) and (-1, f"{by_definition('no id at all'):016x}", None) in got


def test_query_over_a_table(spark, tmp_path):
    texts = ["one two three four", "One two\nthree four", "five six seven", None]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.component_id for r in queries.queries()["op12_simhash"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(components([0, 1, 2, 3], [by_definition(t) for t in texts], 2)))
