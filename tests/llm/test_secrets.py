import hashlib
import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

from hilbertine.llm import secrets

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def added(text):
    """Runs that a window makes secret and no base span covers, by definition."""
    base = [tuple(map(int, x.split(":")[1:])) for x in filter(None, brute(text).split(","))]
    entropy = lambda s: -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())
    out = []
    for m in secrets.CANDIDATE.finditer(text):
        if secrets.is_allowed(m[0]) or any(a <= m.start() and m.end() <= b for a, b in base):
            continue
        for members, window, least in secrets.CLASSES.values():
            stretches = [x[0] for x in members.finditer(m[0]) if not secrets.is_allowed(x[0])]
            if any(entropy(x[i : i + window]) >= least - 1e-12 for x in stretches for i in range(len(x) - window + 1)):
                out.append(f"entropy:{m.start()}:{m.end()}")
                break
    return out


def test_base_spans_and_added_ones(spark):
    rng = random.Random(4)
    parts = ["password=", "PassWd : '", "tokeN", '"secret":"', "api_key = ", "apikey:", "AKIA", "AKIAAKIA", "é𝄞", " ", "\n", "ſecret=", "toKen=", "0123456789abcdef" * 2, "deadbeef", "QWERTYUIOPASDFGH", "Zq8xT2mV9bLk4pWc7rYd", "plainwords"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(400)]
    for r in secrets.scan_secrets(docs(spark, texts)).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert sorted(r.spans.split(",")) == sorted([*filter(None, want.split(",")), *added(texts[r.doc_id])] or [""])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k) for k in ("assign", "access", "hex"))


def test_incremental_entropy_equals_the_definition():
    rng = random.Random(5)
    for _ in range(60):
        s = "".join(rng.choice("abcdef0123") for _ in range(rng.randint(20, 70)))
        want = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
        assert abs(secrets.hottest_window(s, 20) - want) < 1e-9


def test_allow_list():
    assert secrets.is_secret("Zq8xT2mV9bLk4pWc7rYd")
    assert not any(map(secrets.is_secret, ["internationalisations", "some-very-long-words-here", "550e8400-e29b-41d4-a716-446655440000", "00000000000000000000000"]))
    assert secrets.redact_secrets("a token=abcdefgh1 b") == "a [SECRET] b"


def test_spans_that_touch_are_redacted_whole():
    key = "0123456789abcdef0123456789abcdefXq9ZtR7vLm2Kp8Ws"
    assert secrets.find_secrets(f"see {key}") == ([(4, 2, 36)], [(4, 3, 52)])
    assert secrets.redact_secrets(f"see {key}, and token={key}.") == "see [SECRET], and [SECRET]"
    assert secrets.redact_secrets("no") == "no" and secrets.redact_secrets(None) is None


def test_edges(spark):
    rows = secrets.scan_secrets(edges(spark)).collect()
    assert len(rows) == 8 and {r.spans for r in rows} == {""}
    assert secrets.scan_secrets(none(spark)).count() == 0


def test_hex_keys_behind_other_characters():
    rng = random.Random(6)
    for form, digits, n in (("sig={}", "0123456789ABCDEF", 32), ("/{}", "0123456789ABCDEF", 32), ("v1/{}/x", "0123456789abcdef", 28)):
        runs = [form.format("".join(rng.choice(digits) for _ in range(n))) for _ in range(200)]
        assert sum(secrets.find_secrets(f"see {r} there") == ([], [(4, 3, 4 + len(r))]) for r in runs) >= 198
    assert not any(map(secrets.is_secret, ["id=550e8400-e29b-41d4-a716-446655440000", "no=123456789012345678901234567890", "path/to/internationalisations/of/words2"]))


def test_planted_random_secrets_are_found_whole(spark):
    """Random keys of the usual alphabets and lengths among plain words; 97 of 100 are found whole, and nothing else is."""
    rng = random.Random(12)
    letters, lower, upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [(letters + "0123456789", 24), (letters + "0123456789+/", 40), (letters + "0123456789_-", 32), (upper + "234567", 32), ("0123456789ABCDEF", 40), (lower + "0123456789", 36)]
    words = ["river", "well-known", "2024-05-17", "internationalisation", "and/or", "10000000000000000000", "reader_s", "x=y"]
    texts, planted = [], []
    for i in range(600):
        alphabet, n = kinds[i % len(kinds)]
        before, key = " ".join(rng.choices(words, k=rng.randint(0, 9))) + " ", "".join(rng.choices(alphabet, k=n))
        texts.append(before + key + " " + " ".join(rng.choices(words, k=5)))
        planted.append(f"entropy:{len(before)}:{len(before) + n}")
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs(spark, texts)).collect()}
    assert sum(got[i] == x for i, x in enumerate(planted)) >= 582 and all(got[i] in ("", x) for i, x in enumerate(planted))


def test_very_long_text(spark):
    text = "plain words " * 830_000 + "Zq8xT2mV9bLk4pWc7rYd"
    (r,) = secrets.scan_secrets(docs(spark, [text])).collect()
    assert r.spans == f"entropy:{len(text) - 20}:{len(text)}" and r.n_entropy == 1
