import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hilbertine.llm import toxicity as tox

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "é", "sto"]) for _ in range(rng.randint(1, 4)))
    texts, toxic = [], []
    for _ in range(n):
        w = [word() for _ in range(rng.choice([8, 40, 200]))]
        bad = rng.random() < 0.2
        for _ in range(max(2, len(w) // 40) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["Grumfel", "snorkish", "vilk" + word()])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy_and_labels_kept_apart(spark):
    texts, toxic = corpus(1600)
    d, held = docs(spark, texts), tox.remainder(F.col("doc_id"), 4) == 2
    # labels of held-out rows are turned round: they must not matter
    marks = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in enumerate(toxic)]
    labels = spark.createDataFrame([*marks, (None, 1), (99999, 1), marks[0]], "doc_id long, toxic int")
    model = tox.train(d, labels, ~held)
    rows = tox.score_documents(d, model, held).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 300 and sum(r.predicted == toxic[r.doc_id] for r in out) / len(out) > 0.97
    kept = tox.keep_ordinary(d, model)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if not r.predicted)


def counts(rng, size, rate):
    table = rng.poisson(rate, (size, size))
    table[4] = 0
    return table, tox.Counts(np.arange(size * size), table.ravel(), (table > 0).sum(0) + rng.poisson(1, size), table.sum(1), (table > 0).sum(1))


def test_kneser_ney_is_a_distribution_with_shared_backoff():
    rng = np.random.default_rng(2)
    (a, toxic), (_, ordinary) = counts(rng, 30, 0.3), counts(rng, 30, 2)
    shared = toxic.continuation + ordinary.continuation
    model = tox.KneserNey(toxic, shared)
    p = model.pair.reshape(30, 30)
    assert np.allclose(p.sum(1), 1) and (p > 0).all() and np.isclose(model.single.sum(), 1)
    v, w = 3, int(np.argmax(a[3]))
    total = toxic.continuation.sum()
    kept = np.maximum(toxic.continuation - 0.75, 0)
    single = (kept + (total - kept.sum()) * (shared + 1) / (shared + 1).sum()) / total
    assert np.isclose(p[v, w], (a[v, w] - 0.75 + 0.75 * (a[v] > 0).sum() * single[w]) / a[v].sum())
    assert np.allclose(p[4], single) and np.allclose(model.single, single)
    nothing = tox.KneserNey(tox.Counts(np.arange(30), *(np.zeros(30) for _ in range(4))), shared)
    assert np.allclose(nothing.pair, (shared + 1) / (shared + 1).sum())
    both = tox.Evidence(toxic, ordinary, shared)
    of = lambda e: e.of(np.repeat(np.arange(30), 30), np.tile(np.arange(30), 30))
    want = np.log(p.ravel()) - np.log(tox.KneserNey(ordinary, shared).pair)
    want[0] = both.word[0]  # two unknown words
    assert np.allclose(of(both), want)
    few = [tox.Counts(c.keys[::7], c.n[::7], c.continuation, c.seen, c.kinds) for c in (toxic, ordinary)]
    assert np.allclose(of(tox.Evidence(*few, shared)), np.where((np.arange(900) % 7 == 0) & (np.arange(900) > 0), want, np.tile(both.word, 30)))


def test_counts_against_a_loop(spark):
    texts, toxic = corpus(300, 7)
    d = docs(spark, texts)
    training = tox._training(d, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), F.lit(True))
    hashes = {}

    def tokens(t):
        data = np.frombuffer(t.encode(), np.uint8)
        _, words, stems = tox._tokens(data, np.array([0, len(data)]))
        hashes.update(zip(words.view(np.int64).tolist(), t.lower().split(), strict=True))
        return words.view(np.int64).tolist(), stems.view(np.int64).tolist()

    want = {}
    for t, c in zip(texts, toxic, strict=True):
        w, s = tokens(t)
        for k in [*set(w), *set(s)]:
            want.setdefault(k, [0, 0])[c] += 1
    got = {r.token: [r.n0, r.n1] for r in tox._token_documents(training).collect()}
    assert got == want

    n = [toxic.count(0), toxic.count(1)]
    expected = lambda k: sum(2 * x * np.log(x / m) for c in (0, 1) for x, m in ((want[k][c], n[c] * sum(want[k]) / sum(n)), (n[c] - want[k][c], n[c] * (1 - sum(want[k]) / sum(n)))) if x) * (want[k][1] * n[0] >= 2 * want[k][0] * n[1])
    rows = tox._token_documents(training).selectExpr("token", f"{tox.leaning(*n)} as lean").collect()
    assert all(np.isclose(r.lean, expected(r.token), atol=1e-6) for r in rows)
    vocabulary = tox._vocabulary(training, *n, 1 << 18)
    level = 2 * np.log(len(want))
    assert {hashes.get(k) for k in vocabulary.tokens.view(np.int64).tolist()} >= {"grumfel", "snorkish"}
    assert set(vocabulary.tokens.view(np.int64).tolist()) == {k for k in want if expected(k) >= level}

    size = len(vocabulary.tokens) + 1
    counted = tox._Corpus(tox._bigrams(training, spark.sparkContext.broadcast(vocabulary), size), size)
    pairs, before, kinds = {}, {}, set()
    for t, c in zip(texts, toxic, strict=True):
        w, s = (np.asarray(x, np.int64).view(np.uint64) for x in tokens(t))
        ids = vocabulary.ids(w, s).tolist()
        for (p, i), (h, k) in zip(zip([0, *ids], ids), zip([0, *w.tolist()], w.tolist())):
            pairs[c, p * size + i] = pairs.get((c, p * size + i), 0) + 1
            if i:
                before.setdefault((c, i), set()).add(h)
            if c:
                kinds.add((h, k))
    total = lambda c: {k: v for (x, k), v in pairs.items() if x == c}
    toxic_, ordinary_ = total(1), total(0)
    word = {w: [sum(v for k, v in t.items() if k % size == w) for t in (ordinary_, toxic_)] for w in range(size)}
    seen = counted.seen
    for b in range(size):
        here = [k for k in toxic_ if k // size == b]
        assert seen.loc[b, "n2"] + seen.loc[b, "n3"] == sum(toxic_[k] for k in here) and seen.loc[b, "k23"] == len(here)
    keys = sorted((set(toxic_) | set(ordinary_)) - {0})
    apart = []
    for k in keys:
        n, share = [ordinary_.get(k, 0), toxic_.get(k, 0)], (word[k % size][1] + 0.5) / (sum(word[k % size]) + 1)
        if sum(2 * x * np.log(x / (sum(n) * q)) for x, q in zip(n, (1 - share, share), strict=True) if x) >= 2 * np.log(len(keys)):
            apart.append(k)
    assert counted.pairs["key"].tolist() == apart
    assert all(r.n2 + r.n3 == toxic_.get(r.key, 0) and r.n0 + r.n1 == ordinary_.get(r.key, 0) for r in counted.pairs.itertuples())
    found = counted._continuation([2, 3])
    assert found[1:].tolist() == [len(before.get((1, i), ())) for i in range(1, size)]
    assert abs(found.sum() - len(kinds)) <= 0.1 * len(kinds)


def test_number_of_different_hashes():
    rng = np.random.default_rng(5)
    for n in (10, 4095, 100_000):
        least = np.unique(rng.integers(0, 2**63, n, dtype=np.int64))[: tox.KEPT_HASHES]
        assert abs(tox.different(least) - n) <= 0.1 * n


def test_evidence_by_a_loop():
    vocabulary = tox.Vocabulary([int(h.view(np.int64)) for t in ("snork", "the") for h in tox._tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1]])
    rng = np.random.default_rng(3)
    toxic, ordinary = (tox.Counts(np.array([1, 2, 5, 7]), rng.poisson(3, 4) + 1, rng.poisson(4, 3), np.full(3, 40), np.full(3, 3)) for _ in range(2))
    evidence = tox.Evidence(toxic, ordinary, toxic.continuation + ordinary.continuation)
    texts = ["the snork xx the", "", "xx", "Snork snork"]
    ids = {t: vocabulary.ids(*tox._tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1:]).tolist() for t in texts if t}
    got = list(tox._text_evidence(pa.array(texts), vocabulary, [evidence]))
    total = np.concatenate([g[0] for g in got])
    for t, x in zip(texts, total, strict=True):
        i = ids.get(t, [])
        assert np.isclose(x, sum(evidence.of(np.array([a]), np.array([b]))[0] for a, b in zip([0, *i], i)), atol=1e-5)


def test_edges(spark):
    for d, labels in [(edges(spark), spark.createDataFrame([(4, 1), (5, 0), (1, 0)], "doc_id long, toxic int")), (edges(spark), spark.createDataFrame([], "doc_id long, toxic int"))]:
        rows = tox.score_documents(d, tox.train(d, labels)).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    model = tox.train(none(spark), labels)
    assert tox.score_documents(none(spark), model).count() == 0


def test_beyond_the_broadcast_nothing_is_dropped(spark):
    """Tokens or pairs beyond what is broadcast are joined from tables, and give the scores that the broadcast ones give."""
    texts, toxic = corpus(400, 5)
    texts += [None, "", " - "]
    d = docs(spark, texts).union(docs(spark, texts[:3]))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    whole = tox.train(d, labels)
    assert len(whole.vocabulary.tokens) > 2 and len(whole.table.keys) > 1
    held = F.col("doc_id") % 2 == 1
    want = sorted((r.doc_id, r.held_out, r.predicted, r.score) for r in tox.score_documents(d, whole, held).collect())
    for most in ({"most_tokens": 1}, {"most_pairs": 1}):
        model = tox.train(d, labels, **most)
        got = sorted((r.doc_id, r.held_out, r.predicted, r.score) for r in tox.score_documents(d, model, held).collect())
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=0.01)
        assert model.tokens.count() == len(whole.vocabulary.tokens) and model.pairs.count() == len(whole.table.keys)
        words = {r.id: r.e for r in model.words.collect()}
        assert np.allclose([words[t] for t in whole.vocabulary.tokens.view(np.int64).tolist()], whole.table.word[1:], atol=0.02)
        kept = tox.keep_ordinary(d, model)
        assert kept.columns == d.columns and kept.count() == sum(not r[2] for r in got)
