import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from hilbertine.llm import line_dedup as ld
from hilbertine.llm import queries
from hilbertine.llm.editing import similar

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402


def normal(line):
    found = list(ld._lines(pa.array([line]), 1))
    return found[0].normal(0).split(" ") if found else []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(texts, min_words, similarity):
    """The lines that go, (text, number), by all pairs of lines, and how many groups have several lines.

    Pairs are compared by ``similar``, which has a test of its own against the definition.
    """
    norms = {}
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if len(normal(line)) >= min_words:
                norms.setdefault(" ".join(normal(line)), []).append((i, n))
    keys = list(norms)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for i in range(len(keys)) for j in range(i) if abs(len(keys[i]) - len(keys[j])) <= (1 - similarity) * max(len(keys[i]), len(keys[j])) + 1e-9]
    for (i, j), hit in zip(pairs, similar([keys[i] for i, _ in pairs], [keys[j] for _, j in pairs], similarity), strict=True):
        if hit:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).extend(norms[k])
    return {x for g in groups.values() for x in sorted(g)[1:]}, len([g for g in groups.values() if len(g) > 1])


def gone(before, after):
    """Which lines of texts went; a text keeps the order of its lines."""
    out = set()
    for i, (x, y) in enumerate(zip(before, after, strict=True)):
        left = (y or "").split("\n")
        for n, line in reversed(list(enumerate((x or "").split("\n")))):
            if left and left[-1] == line:
                left.pop()
            else:
                out.add((i, n))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    pool = [[word() for _ in range(rng.choice([3, 6, 12, 30]))] for _ in range(50)]
    out = []
    for _ in range(100):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(pool)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 15))]
            if rng.random() < 0.6 and len(w) > 1:
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice([" ", ", "]).join(w).capitalize() + rng.choice([".", "", " "]))
        out.append("\n".join(lines) + rng.choice(["", "\n"]))
    return [*out, None, ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs(spark, texts).repartition(3)).collect()}
    want, groups = brute(texts, 5, 0.8)
    found = gone(texts, [got[i] for i in range(len(texts))])
    assert groups > 20 and not found - want and len(found) >= 0.97 * len(want)


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    texts = corpus(3)
    want = sorted((r.doc_id, r.text or "") for r in ld.dedup_lines(docs(spark, texts)).collect())
    monkeypatch.setattr(ld, "BLOCK_LINES", 2)
    monkeypatch.setattr(ld, "HOT", 0)
    assert sorted((r.doc_id, r.text or "") for r in ld.dedup_lines(docs(spark, texts)).collect()) == want


@pytest.mark.parametrize(("inner", "outer"), [(1, 1), (1, 3), (2, 1), (3, 4)])
def test_any_two_classes_meet_in_one_block(spark, inner, outer):
    sides = [("true", c) for c in range(inner)] + [("false", c) for c in range(outer)]
    row = spark.range(1).selectExpr(*[f"{ld._blocks(f'{inner}L', f'{outer}L', side, f'{c}L')} as x{i}" for i, (side, c) in enumerate(sides)]).first()
    for i, x in enumerate(sides):
        for j, y in enumerate(sides):
            met = len([k for k in set(row[i]) & set(row[j]) if k <= 0 or i != j])
            assert met == (0 if (inner, outer) != (1, 1) and x[0] == y[0] == "true" else 1)


def test_columns_stay_and_counts_follow(spark):
    line = "This work is licensed under the terms below"
    d = docs(spark, [f"{line}\nfirst", f"second\n{line}!", "THIS work is licensed under the terms below\n"])
    got = ld.dedup_lines(d).orderBy("doc_id").collect()
    assert [r.text for r in got] == [f"{line}\nfirst", "second", ""]
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and [r.n_lines_dropped for r in got] == [0, 1, 1]
    assert ld.dedup_lines(d).columns == [*d.columns, "n_lines_dropped"]


def test_edges(spark):
    rows = ld.dedup_lines(edges(spark)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_lines_dropped) for r in rows)[4:7] == [(4, "One two three four five six seven.", 0)] * 2 + [(5, "", 1)]
    assert ld.dedup_lines(none(spark)).count() == 0


def test_edit_similarity():
    rng = random.Random(8)
    pairs = []
    for _ in range(2000):
        a = "".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 5, 40, 63, 64, 65, 129, 600])))
        b = list(a)
        for _ in range(rng.randint(0, max(6, len(a) // 5))):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 2)] = [rng.choice("abc é漢")] * rng.randint(0, 2)
        pairs.append((a, "".join(b)))
    pairs = pairs[:300] + [p for p in pairs[300:] if len(p[0]) < 200]
    got = similar([a for a, _ in pairs], [b for _, b in pairs], 0.8).tolist()
    assert got == [distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs] and 0.1 < sum(got) / len(got) < 0.95


def test_unspaced_scripts_count_by_pairs_of_characters(spark):
    line = "本作品は次の条件の下で自由に利用することができます。"
    got = ld.dedup_lines(docs(spark, [f"{line}\n短い", line.replace("自由", "無料"), "短い", "x"])).orderBy("doc_id").collect()
    assert [r.text for r in got] == [f"{line}\n短い", "", "短い", "x"]
    data = np.frombuffer("漢字a bc 字".encode(), np.uint8)
    _, start, end = ld.split_wide(data, *ld.words(data, np.array([0, len(data)]), ld.LETTERS))
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == ["漢字", "字a", "bc", "字"]


def test_clashing_columns_and_emptied_documents(spark):
    line = "This work is licensed under the terms below"
    d = docs(spark, [line, line.upper(), "", None]).selectExpr("*", "7 as n_lines_dropped", "1 as gone", "2 as doc", "3 as rest", "4 as drop_id")
    got = ld.dedup_lines(d, drop_emptied=True).orderBy("doc_id")
    assert [(r.text, r.n_lines_dropped, r.gone, r.doc, r.rest) for r in got.collect()] == [(line, 0, 1, 2, 3), ("", 0, 1, 2, 3), (None, 0, 1, 2, 3)]
    assert sorted(got.columns) == sorted(d.columns)


def edited(rng, replaced):
    """A line and a copy with so many words replaced, at an edit similarity of 0.8 or more."""
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(2, 9)))
    pool = [word() for _ in range(400)]
    while True:
        a = [rng.choice(pool) for _ in range(rng.choice([6, 12, 25, 50]) * replaced)]
        b = list(a)
        for i in rng.sample(range(len(a)), replaced):
            b[i] = rng.choice(pool)
        x, y = " ".join(a), " ".join(b)
        if x != y and similar([x], [y], 0.8)[0]:
            return x, y


@pytest.mark.parametrize("replaced", [1, 2])
def test_query_finds_lines_with_replaced_words(spark, tmp_path, replaced):
    rng = random.Random(replaced)
    pairs = [edited(rng, replaced) for _ in range(150)]
    docs(spark, [x for p in pairs for x in p]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert all(got[2 * i] == a for i, (a, _) in enumerate(pairs))
    assert sum(got[2 * i + 1] == "" for i in range(150)) >= 148
