import random
import sys
import unicodedata
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from hilbertine.llm import language as lang

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, edges, none  # noqa: E402

PARTS = {"aa": ["the", "ing", "ou", "er", "sh"], "bb": ["ich", "und", "ä", "sch", "ung"], "cc": ["при", "вет", "ост", "ня"], "dd": ["віт", "ї", "ост", "ськ"]}


def words(rng, name, n):
    return ["".join(rng.choice(PARTS[name]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        name = rng.choice(list(PARTS))
        out.append((" ".join(words(rng, name, rng.choice([3, 30, 200]))).capitalize() + " 12.", name))
    return out


def test_held_out_accuracy_and_spans(spark):
    rows = corpus(600)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    # the languages of held-out rows are hidden behind a wrong one
    data = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else x, None, None, 0, 0, "") for i, (t, x) in enumerate(rows)]
    d = spark.createDataFrame(data, SCHEMA)
    model = lang.train(d, ~held)
    got = lang.identify(d, model, held).collect()
    out = [r for r in got if r.held_out]
    assert len(out) > 150 and sum(r.lang_pred == rows[r.doc_id][1] for r in out) / len(out) > 0.98
    rng = random.Random(3)
    first, second = " ".join(words(rng, "aa", 40)), " ".join(words(rng, "bb", 30))
    mixed = spark.createDataFrame([(1, f"¿{first}, {second}!", None, None, None, 0, 0, "")], SCHEMA)
    (r,) = lang.identify(mixed, model).collect()
    spans = [s.split(":") for s in r.spans.split(",")]
    assert r.lang_pred == ("aa" if len(first.replace(" ", "")) > len(second.replace(" ", "")) else "bb") and [s[0] for s in spans] == ["aa", "bb"]
    assert abs(int(spans[0][2]) - (1 + len(first))) <= 12 and int(spans[1][2]) == len(first) + len(second) + 3


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    count = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(0, 3, (count.sum(), 3)).astype(np.float32)
    first = np.cumsum(count) - count
    label = lang.viterbi(scores, first, count, 2.0)
    cost = lambda path, f: sum(scores[f + i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    for f, n in zip(first, count, strict=True):
        if n:
            best = max(cost(p, f) for p in product(range(3), repeat=int(n)))
            assert abs(cost(label[f : f + n].tolist(), f) - best) < 1e-4


def test_scripts_narrow_the_languages(spark):
    model = lang.train(spark.createDataFrame([(i, t, x, None, None, 0, 0, "") for i, (t, x) in enumerate(corpus(200, 5))], SCHEMA))
    w = lang.Words(["Under привет", "日本"])
    s = model.word_scores(w)
    assert w.row.tolist() == [0, 0, 1] and w.start.tolist() == [0, 6, 0]
    assert (s[0] > -1e5).tolist() == [True, True, False, False] and (s[1] > -1e5).tolist() == [False, False, True, True] and (s[2] > -1e5).all()


def test_letters_are_those_of_unicode():
    lower, script = lang._tables()
    for i in random.Random(6).sample(range(0x30000), 3000):
        assert (lower[i] > 0) == (unicodedata.category(chr(i))[0] == "L") == (script[i] > 0)


def test_edges(spark):
    model = lang.train(edges(spark))
    rows = {r.doc_id: r for r in lang.identify(edges(spark), model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0 and rows[6].lang_pred == "fr"
    assert lang.identify(none(spark), lang.train(none(spark))).count() == 0
    assert {r.lang_pred for r in lang.identify(edges(spark), lang.train(none(spark))).collect()} == {"und"}
