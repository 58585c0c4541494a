"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each five-word shingle is hashed once; the high bits of the hash choose a bin
and the bin keeps its least hash. Optimal densification fills an empty bin
from the first filled bin of a random sequence of its own. The low-order bits of
each bin are packed; the share of equal bins, corrected for chance, estimates
the Jaccard similarity of the sets of shingles.

The next document is found by dealing the rows out over ranges of doc_id, whose
first rows are dealt to the range before as well, so that no sort is global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, SHINGLE = 256, 5
#: Low-order bits that are kept of each bin.
KEPT_BITS = 8
#: Random probes before an empty bin takes the filled bin that comes first in the whole of its sequence.
PROBES = 6
#: Rows of one range of ids, most ranges, and boundaries looked through at a time.
RANGE_ROWS, RANGES, STEP = 1_000, 10_000, 100

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POSITIVE = 2**63 - 1


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and binds it to ``name`` in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _probe(i: int, k: int, bins: int) -> int:
    """The k-th bin that bin i asks: a fixed mixing of both."""
    x = (i * 0x9E3779B97F4A7C15 + k * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return (x ^ (x >> 31)) % bins


def _ints(values: list[int]) -> str:
    return f"array({', '.join(map(str, values))})"


def packed_minima(text: str, n: int = SHINGLE, bins: int = BINS, probes: int = PROBES) -> str:
    """SQL for the kept bits of each bin of a text's fingerprint, an array of ``bins`` numbers.

    Words are what blanks part, A-Z lower-cased. A text of fewer than ``n`` words has
    its whole sequence as its one shingle, also if that is empty.
    """

    def bin_of(x: str) -> str:
        return f"cast(shiftright({x}, {63 - (bins.bit_length() - 1)}) as int)"

    words = f"transform(filter(split(translate({text}, '{UPPER}', '{LOWER}'), '[\\\\x09-\\\\x0D ]+'), x -> x <> ''), x -> xxhash64(x))"
    picks = ", ".join(f"get(w, i + {k})" for k in range(n))
    hashes = f"if(size(w) < {n}, array(xxhash64(w, size(w)) & {POSITIVE}), transform(sequence(0, size(w) - {n}), i -> xxhash64({picks}) & {POSITIVE}))"
    least = f"filter(s, (x, i) -> i = 0 or {bin_of('x')} <> {bin_of('get(s, i - 1)')})"
    gap = f"{bin_of('x')} - coalesce({bin_of('get(m, i - 1)')}, -1) - 1"
    empty = "array_repeat(cast(null as bigint), {})"
    dense = f"concat(flatten(transform(m, (x, i) -> concat({empty.format(gap)}, array(x)))), {empty.format(f'{bins - 1} - ' + bin_of('get(m, size(m) - 1)'))})"
    asked = ", ".join(f"get(d, get({_ints([_probe(i, k, bins) for i in range(bins)])}, j))" for k in range(probes))
    rest = f"array_min(transform(m, x -> struct(hash({bin_of('x')}, j) as h, x as x))).x"
    # a copied hash is hashed with its bin, lest the copies of a short text's few hashes agree or differ all together
    packed = f"transform(d, (v, j) -> cast(coalesce(v, hash(coalesce({asked}, {rest}), j)) & {2**KEPT_BITS - 1} as smallint))"
    return _let(words, "w", _let(f"array_sort({hashes})", "s", _let(least, "m", _let(dense, "d", packed))))


def as_text(packed: str) -> str:
    """SQL for the fingerprint as a string: two hexadecimal digits for each bin."""
    digits = ", ".join(f"'{i:02x}'" for i in range(2**KEPT_BITS))
    return f"array_join(transform({packed}, x -> get(array({digits}), x)), '')"


def likeness(a: str, b: str) -> str:
    """SQL for the estimated Jaccard similarity: the share of equal bins, less what chance makes equal, 0 at least."""
    chance = 1 / 2**KEPT_BITS
    return f"greatest(0D, (size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z)) / size({a}) - {chance}D) / {1 - chance}D)"


def _with_range(rows: DataFrame, per_range: int) -> DataFrame:
    """``rows`` with ``part`` and ``late``: each row in its range of k, and the first row of the next range (late) at the end."""
    n, least = rows.agg(F.count("*"), F.min("k")).first()
    parts = max(1, min(RANGES, -(-n // per_range)))
    cuts: list[int] = []
    if parts > 1:
        shares = ", ".join(f"{i / parts:.8f}D" for i in range(1, parts))
        found = rows.agg(F.expr(f"percentile_approx(k, array({shares}), {max(10_000, 20 * parts)})")).first()[0]
        cuts = sorted({x for x in found if x > least})
    coarse = cuts[::STEP]
    inside = f"size(filter(slice(array({', '.join(f'{x}L' for x in cuts) or '0L'}), (c - 1) * {STEP} + 1, {STEP}), x -> x <= k))"
    place = f"if(c = 0, 0, (c - 1) * {STEP} + {inside})"
    c = f"size(filter(array({', '.join(f'{x}L' for x in coarse)}), x -> x <= k))" if coarse else "0"
    placed = rows.withColumn("c", F.expr(c)).withColumn("r", F.expr(place)).drop("c")
    first = f"k in ({', '.join(f'{x}L' for x in cuts)})" if cuts else "false"
    once = "array(struct(r as part, 0 as late))"
    back = f"if({first}, array(struct(r - 1 as part, 1 as late)), cast(array() as array<struct<part:int,late:int>>))"
    is_least = f"k = {least}L" if least is not None and least >= -POSITIVE else f"k < -{POSITIVE}L"
    wrap = f"if({is_least}, array(struct({len(cuts)} as part, 1 as late)), cast(array() as array<struct<part:int,late:int>>))"
    return placed.withColumn("at", F.explode(F.expr(f"concat({once}, {back}, {wrap})"))).select("*", "at.part", "at.late").drop("at", "r")


def fingerprint_documents(docs: DataFrame, n: int = SHINGLE, bins: int = BINS, per_range: int = RANGE_ROWS) -> DataFrame:
    """Fingerprint each text of ``docs`` (doc_id, text) and its edited text, one row per row.

    The edited text has the last half of its code points (rounded down) replaced
    by the first as many of the next document's, by doc_id and then text hash; the last row is
    followed by the first. Returns doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (estimated
    similarity to the edited and to the next text, 0 to 1).

    A null text is empty. A null doc_id comes before all others. Rows that
    repeat a doc_id follow one another. A single row is followed by itself. An
    empty table gives no rows; other columns are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("txt"))
    rows = rows.withColumn("k", F.expr(f"coalesce(doc_id, -{POSITIVE}L - 1L)")).withColumn("h", F.xxhash64("txt"))
    order = Window.partitionBy("part").orderBy("late", "k", "h")
    half = "cast(length(txt) div 2 as int)"
    follows = _with_range(rows, per_range).withColumn("next", F.lead("txt").over(order))
    edited = follows.select(
        "doc_id", "k", "h", "part", "late", F.length("txt").cast("long").alias("n_chars"), "txt",
        F.expr(f"concat(substring(txt, 1, length(txt) - {half}), substring(coalesce(next, ''), 1, {half}))").alias("edited"),
    )
    printed = edited.select(
        "doc_id", "k", "h", "part", "late", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(packed_minima("txt", n, bins)).alias("own"), F.expr(packed_minima("edited", n, bins)).alias("changed"),
    )
    both = printed.withColumn("following", F.lead("own").over(order)).filter("late = 0")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(as_text("own")).alias("fingerprint"), F.expr(as_text("changed")).alias("edited_fingerprint"),
        F.expr(likeness("own", "changed")).alias("near_edited"), F.expr(likeness("own", "following")).alias("near_next"),
    )
