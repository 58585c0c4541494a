import hashlib
import random
import re
import sys
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from hilbertine.llm import fingerprints as fp

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, docs, edges, none  # noqa: E402


def edited(texts):
    """Of texts in order, each with its second half replaced by the beginning of the next."""
    return [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, [*texts[1:], texts[0]], strict=True)]


def shingles(t):
    w = [x for x in re.split(r"[\x09-\x0D ]+", t.translate({i: i + 32 for i in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé𝄞F") for _ in range(rng.randint(2, 5)))
    out = [" ".join(word() for _ in range(rng.choice([0, 1, 4, 5, 30, 300, 2500]))) for _ in range(n)]
    for i in range(0, n - 1, 7):
        w = out[i].split(" ")
        w[len(w) // 2 : len(w) // 2 + 2] = [word()]
        out[i + 1] = " ".join(w)
    return out


@pytest.mark.parametrize("per_range", [7, 1000])
def test_next_document_and_estimates(spark, per_range):
    texts = corpus(180)
    ids = random.Random(2).sample(range(-500, 5000), 180)
    order = sorted(ids)
    d = spark.createDataFrame([(i, t, None, None, None, 0, 0, "") for i, t in zip(order, texts, strict=True)], SCHEMA).orderBy(F.rand(3)).repartition(5)
    rows = sorted(fp.fingerprint_documents(d, per_range=per_range).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == order and [r.n_chars for r in rows] == [len(t) for t in texts]
    changed = edited(texts)
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    off = [r.near_edited - jaccard(a, b) for r, a, b in zip(rows, texts, changed, strict=True)]
    off += [r.near_next - jaccard(a, b) for r, a, b in zip(rows, texts, [*texts[1:], texts[0]], strict=True)]
    assert max(map(abs, off)) < 0.16 and sum(map(abs, off)) / len(off) < 0.025 and abs(sum(off) / len(off)) < 0.01
    seen = {}
    assert all(seen.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 512 for r, t in zip(rows, texts, strict=True))


def test_bins_by_definition(spark):
    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    signed = lambda x: x - 2**64 if x >> 63 else x
    rng = random.Random(5)
    w = ["".join(rng.choice("xyzw") for _ in range(6)) for _ in range(4000)]
    wh = [h(x.encode(), 42) for x in w]
    least = {}
    for i in range(len(w) - 4):
        x = 42
        for k in range(5):
            x = h(wh[i + k].to_bytes(8, "little"), x)
        x &= 2**63 - 1
        least[x >> 55] = min(least.get(x >> 55, 2**63), x)
    assert len(least) == 256
    got = spark.createDataFrame([(" ".join(w),)], "t string").select(F.expr(fp.packed_minima("t"))).first()[0]
    assert got == [least[b] & 255 for b in range(256)] and signed(1) == 1


def murmur3(*values):
    """Spark's hash of integers, (value, bytes) each, as a signed number."""
    mask, h = 2**32 - 1, 42
    for value, size in values:
        for at in range(0, size, 4):
            k = (value >> 8 * at & mask) * 0xCC9E2D51 & mask
            h ^= (k << 15 | k >> 17) * 0x1B873593 & mask
            h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
        h ^= size
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        h ^= h >> 16
    return h - 2**32 if h >> 31 else h


def least_of_bins(t, bins):
    """The least hash of each bin that has one."""
    out, bits = {}, bins.bit_length() - 1
    w = [x for x in re.split(r"[\x09-\x0D ]+", t) if x]
    wh = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    for i in range(len(w) - 4):
        x = 42
        for k in range(5):
            x = xxhash.xxh64_intdigest(wh[i + k].to_bytes(8, "little"), x)
        x &= 2**63 - 1
        out[x >> 63 - bits] = min(out.get(x >> 63 - bits, 2**63), x)
    return out


@pytest.mark.parametrize(("bins", "probes"), [(256, 6), (256, 1), (32, 2)])
def test_empty_bins_by_definition(spark, bins, probes):
    """An empty bin takes the first filled one that it asks, or else the first of all filled ones in its sequence."""
    rng = random.Random(bins + probes)
    texts = [" ".join("".join(rng.choice("pqrs") for _ in range(6)) for _ in range(n)) for n in (5, 6, 9, 20, 60, 300, 1200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr(fp.packed_minima("t", 5, bins, probes)).alias("f")).collect()
    empty = by_rest = 0
    for r in got:
        least = least_of_bins(r.t, bins)
        for j in range(bins):
            want = least.get(j)
            if want is None:
                empty += 1
                asked = [p for p in (fp._probe(j, k, bins) for k in range(probes)) if p in least]
                by_rest += not asked
                source = least[asked[0]] if asked else min((murmur3((b, 4), (j, 4)), x) for b, x in least.items())[1]
                want = murmur3((source, 8), (j, 4))
            assert r.f[j] == want & 255
    assert empty > 60 and by_rest > 10


def test_very_long_text(spark):
    """10^7 characters, one text of a single word and one of many."""
    texts = ["x" * 10_000_000, "ab cd " * 400_000, "short"]
    rows = sorted(fp.fingerprint_documents(docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.n_chars for r in rows] == [len(t) for t in texts]
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in edited(texts)]


def test_edges(spark):
    rows = fp.fingerprint_documents(edges(spark), per_range=3).collect()
    assert len(rows) == 8 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = [r for r in rows if r.doc_id in (4, 5)]
    assert len({r.fingerprint for r in same}) == 1 and sorted(r.near_next for r in same)[1:] == [1.0, 1.0]
    (one,) = fp.fingerprint_documents(docs(spark, ["abc def"])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()
    assert fp.fingerprint_documents(none(spark)).count() == 0
