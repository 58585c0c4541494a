"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing.

Fingerprints are 64-bit numbers, kept as signed bigints. A null or blank text has
the fingerprint zero and is linked like any other; repeated rows come back as often
as they came; a null ``doc_id`` is never the smallest of a component, which is null if
it has no other. Extra columns, whatever their names, are not read. A text of any length is
hashed in blocks of ``BLOCK`` shingles; the text itself and its words are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import connected_components
from .scratch import materialise
from .text import LOWER

#: Bits of a fingerprint, segments that it is cut into, and shingles hashed at a time.
BITS, SEGMENTS, BLOCK = 64, 4, 1 << 15
SEED = 42


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text: a bit is 1 if it is set in over half of the shingles' XXH64 hashes, repeats included.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a text of fewer words than
    ``shingle`` has its whole sequence as its only shingle.
    """
    words = text.translate(LOWER).split()  # of bytes: at \x20 and \x09 to \x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    total, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(first[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [simhash(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def near_pairs(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) for every two different values of ``fp`` that differ in at most ``distance`` (0 to 2) bits, each pair once.

    Multi-index hashing with four tables; each leaves one of the four 16-bit segments out. Of two differing bits at most one
    lies outside the first segment that differs. So each fingerprint looks up, in the table without segment s, its
    other 48 bits as they are, and with one bit of a later segment set that it has not: the Hamming ball of radius one,
    in one direction. A table's entry stands for at most 2^16 fingerprints, for the rest of their bits are given; whole
    distances are verified within the join, which gives the links alone.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the distance must be 0 to 2")
    if not distance:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    width = BITS // SEGMENTS
    left_out = [((1 << width) - 1) << (width * s) for s in range(SEGMENTS)]
    kept = [m - (1 << BITS) if (m := (1 << BITS) - 1 - x) >> (BITS - 1) else m for x in left_out]
    tables = ", ".join(f"named_struct('t', {s}, 'kept', {m}L)" for s, m in enumerate(kept))
    flips = "array(-1)" if distance == 1 else f"concat(array(-1), if(t = {SEGMENTS - 1}, array(), sequence({width} * (t + 1), {BITS - 1})))"
    distinct = fps.select("fp").distinct()
    index = distinct.select(F.col("fp").alias("b"), F.inline(F.expr(f"array({tables})"))).selectExpr("t", "b & kept as key", "b")
    probes = distinct.select(F.col("fp").alias("a"), F.inline(F.expr(f"array({tables})"))).select("a", "t", "kept", F.explode(F.expr(flips)).alias("bit"))
    probes = probes.withColumn("set", F.expr("if(bit < 0, 0L, shiftleft(1L, bit))")).filter("a & set = 0").selectExpr("t", "(a & kept) | set as key", "a", "bit")
    # one bit apart, or two in one segment: found as they are; two in two segments: found by setting the latter
    near = F.expr(f"if(bit < 0, a < b and bit_count(a ^ b) <= {distance}, bit_count(a ^ b) = 2)")
    return probes.join(index, ["t", "key"]).filter(near).select("a", "b")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    Texts of one fingerprint are one class; classes are linked by ``near_pairs``, and a component's id is the smallest ``doc_id`` in
    it. All tables hold 8 to 24 bytes a document; only links between different fingerprints are made.
    """
    each = materialise(fingerprints(docs, shingle))
    classes = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected_components(near_pairs(classes, distance)).withColumnRenamed("node", "fp")
    placed = classes.join(linked, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = materialise(placed.join(least, "comp").select("fp", "component_id"))
    return each.join(of_class, "fp").select("doc_id", F.expr("lower(lpad(hex(fp), 16, '0'))").alias("fingerprint"), "component_id")
