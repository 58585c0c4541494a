import hashlib
import random
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

from hilbertine.llm import pii

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_against_brute_force(spark):
    rng = random.Random(7)
    parts = ["a.b@c.de", "@", ".", "_", "x@y.z@w.v", "1.2.3.4", "255.256.1.1", "0010.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "5", " ", "-", "  ", "+1 (988) 555-2485", "+44", "(", ")", "é𝄞", "\n", "word", "٣", "123456789012345678901", "79927398713"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    for r in pii.find_personal_data(docs(spark, texts)).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k in pii.KINDS[:4])
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def terms(spark, texts, **more):
    return {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.find_personal_data(docs(spark, texts), **more).collect()}


def test_terms_that_give_an_entity_away(spark):
    texts = [f"note {i}: Quixotina wrote from q@mail.example.com about things" for i in range(6)]
    texts += [f"filler {i} wrote about things from somewhere, note" for i in range(200)]
    for bound in (100_000, 0):
        got = terms(spark, texts, term_bound=bound)
        assert got[0] == [f"term:{texts[0].index('Quixotina')}:{texts[0].index('Quixotina') + 9}"]
        assert not got[50]
    found = pii.find_personal_data(docs(spark, texts))
    d = docs(spark, texts).withColumn("cut", F.lit(1)).withColumn("found", F.lit(2))
    assert pii.redact(d, found).columns == d.columns
    clean = {r.doc_id: r.text for r in pii.redact(d, found).collect()}
    assert clean[0] == "note 0: [term] wrote from [email] about things" and clean[60] == texts[60]


def test_copies_are_no_support(spark):
    assert not any(terms(spark, ["Quixotina q@mail.example.com"] * 9 + ["other text"] * 50).values())


def test_long_runs_are_linear(spark):
    (row,) = pii.find_personal_data(docs(spark, ["a" * 300_000 + " " + "1" * 300_000 + "@"])).collect()
    assert row.spans == ""


def test_edges(spark):
    rows = pii.find_personal_data(edges(spark)).collect()
    assert len(rows) == 8 and {r.spans for r in rows} == {""}
    assert pii.find_personal_data(none(spark)).count() == 0


def test_terms_far_from_the_entity_and_in_texts_without_it(spark):
    far = " and so on with things from somewhere" * 20
    texts = [f"note {i}: wrote from q@mail.example.com{far}, Quixotina. Quixotina" for i in range(40)]
    texts += ["Quixotina note: things from somewhere"]
    texts += [f"filler {i} wrote about things from somewhere, and so note with mail example" for i in range(300)]
    got = terms(spark, texts)
    at = [m.start() for m in re.finditer("Quixotina", texts[0])]
    assert got[0] == [f"term:{a}:{a + 9}" for a in at] and got[40] == ["term:0:9"]
    assert not got[50]


LEVELS = {
    "email": lambda v: {v, "user " + re.sub("[^a-z]+", " ", v.split("@")[0]), "domain " + v.split("@")[1]},
    "ip": lambda v: {v, "net " + ".".join(v.split(".")[:3])},
    "card": lambda v: {re.sub("[^0-9]", "", v), "issuer " + re.sub("[^0-9]", "", v)[:6]},
    "phone": lambda v: {re.sub("[^0-9]", "", v), "area " + re.sub("[^0-9]", "", v)[:6]},
}


def disclosing(texts, threshold=0.9, support=3):
    """The terms that give an entity away, by the definition over all pairs of terms and entities."""
    with_term, with_entity, n = {}, {}, len(texts)
    outside = {}
    for i, t in enumerate(texts):
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in filter(None, brute(t).split(",")))]
        for k, a, b in spans:
            for e in LEVELS[k](t[a:b].lower()):
                with_entity.setdefault((k, e), set()).add(i)
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            with_term.setdefault(m[0].lower(), set()).add(i)
            if not any(a < m.end() and m.start() < b for _, a, b in spans):
                outside.setdefault(m[0].lower(), set()).add(i)
    out = set()
    for t, rows in with_term.items():
        for others in with_entity.values():
            both = outside.get(t, set()) & others
            if len({texts[i] for i in both}) >= support and n * len(both) / (len(rows) * len(others)) >= (n / len(others)) ** threshold * (1 - 1e-9):
                out.add(t)
    return out


def test_disclosing_terms_against_the_definition(spark):
    rng = random.Random(12)
    word = lambda k: "".join(rng.choice("aeioulmnrst") for _ in range(k))
    common = [word(4) for _ in range(60)]
    names = [word(6) for _ in range(12)]
    texts = []
    for i in range(500):
        w = [rng.choice(common) for _ in range(25)] + [word(7)]
        if i % 5 == 0:
            who = rng.randrange(12)
            w += [[f"{names[who]}.{rng.randint(1, 99)}@mail{who % 3}.example.com"], [f"10.{who}.7.{rng.randint(1, 250)}"], [f"+1 ({200 + who}) 555-{rng.randint(1000, 9999)}"], ["4111 1111 1111 1111"]][who % 4]
            w += [f"teamof{'abcdefghijkl'[who]}"] + ["the" + "xyz"[who % 3]] * rng.randint(0, 1)
        elif i % 41 == 0:
            w += ["teamof" + rng.choice("abcdefghijkl")]
        rng.shuffle(w)
        texts.append(" ".join(w))
    texts += texts[:40] * 2
    want = disclosing(texts)
    got = set()
    for i, spans in terms(spark, texts).items():
        got |= {texts[i][int(a) : int(b)].lower() for _, a, b in (x.split(":") for x in spans)}
        here = sorted(f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", re.sub(r"\S+@\S+", lambda m: "1" * len(m[0]), texts[i])) if m[0].lower() in want)
        assert sorted(spans) == here
    assert got == want and len([w for w in want if w.startswith("teamof")]) >= 6
