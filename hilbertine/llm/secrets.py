"""Secret scanning by patterns and by the entropy of sliding windows.

Besides the fixed patterns, every long run of token characters is scanned with
a window whose Shannon entropy is kept up to date from counts alone: moving
the window by one changes two counts, hence two terms of the sum. Each
character class has its own window and threshold, and its window moves over every
longest stretch of the class within a run, so that a key of hex digits counts as
such behind a name and "=" or a "/". A run is marked whole, unless a pattern's span covers
it. An allow-list suppresses runs that are known to be harmless.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Character class: (its members, window, least entropy in bits per character).
CLASSES = {
    "hex": (re.compile(r"[0-9a-fA-F]+"), 24, 3.0),
    "alphanumeric": (re.compile(r"[A-Za-z0-9]+"), 20, 3.6),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.9),
}
#: Runs that are not secrets: words, numbers, UUIDs, dates, paths of plain words.
ALLOWED = [
    re.compile(r"[A-Za-z]+([-_/=+][A-Za-z]*)*"),
    re.compile(r"[0-9]+([-_/=+][0-9]*)*"),
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(.)\1*"),
]

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"


def hottest_window(run: str, window: int) -> float:
    """The largest entropy of any window of ``run``, by incremental counts."""
    counts: dict[str, int] = {}
    term = [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    total = best = 0.0  # total: sum of k * log2 k over the counts
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += term[k + 1] - term[k]
        if i >= window:
            old = run[i - window]
            k = counts[old]
            counts[old] = k - 1
            total += term[k - 1] - term[k]
        if i >= window - 1:
            best = max(best, math.log2(window) - total / window)
    return best


def is_allowed(run: str) -> bool:
    return any(a.fullmatch(run) for a in ALLOWED)


def is_secret(run: str) -> bool:
    """Whether a run of token characters is not allowed and holds a stretch of one class that is not allowed either and looks random."""
    if is_allowed(run):
        return False
    for members, window, least in CLASSES.values():
        for m in members.finditer(run):
            if len(m[0]) >= window and not is_allowed(m[0]) and hottest_window(m[0], window) >= least:
                return True
    return False


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, and of those that entropy adds; sorted."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    reach, covered = 0, []  # (start, furthest end so far): a stretch is covered if the last one that starts in time reaches its end
    for a, _, b in base:
        reach = max(reach, b)
        covered.append((a, reach))
    added, i = [], 0
    for m in CANDIDATE.finditer(text):
        while i < len(covered) and covered[i][0] <= m.start():
            i += 1
        if (i == 0 or covered[i - 1][1] < m.end()) and is_secret(m[0]):
            added.append((m.start(), 3, m.end()))
    return base, added


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Find secrets in the whole text of ``docs`` (doc_id, text), one row per document.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans),
    spans (all spans as kind:start:end, code points, end exclusive) and
    n_entropy. A null text is empty; a null doc_id is kept; rows that repeat a
    doc_id are each reported; an empty table gives no rows; other columns are
    not used.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, text in zip(*(batch.slice(at, 512).column(i).to_pylist() for i in (0, 1)), strict=True):
                    base, added = find_secrets(text or "")
                    n = [sum(k == j for _, k, _ in base) for j in range(3)]
                    rows.append((doc_id, *n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(sorted(base + added)), len(added)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def redact_secrets(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every found span replaced; overlapping spans are replaced as one. A null text stays null."""
    if text is None:
        return None
    base, added = find_secrets(text)
    out, at, last = [], 0, -1  # last: where the last replaced stretch ends
    for a, _, b in sorted(base + added):
        if a >= last:
            out += [text[at:a], mark]
        at = last = max(b, at)
    return "".join(out) + text[at:]
