"""Connected components over edge tables, and mergeable counting sketches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .text import mix

#: Counters of a sketch. Counters travel in slabs, which are added up apart from each other.
COUNTERS, SLAB = 1 << 21, 1 << 15
SKETCH_SCHEMA = "slab int, counts binary"
#: Edges that a task contracts at a time.
EDGES = 1 << 19


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, in order, and the smallest node that each reaches by them."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while ((up := root[root]) != root).any():
            root = up


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) that connect the same nodes: of every ``most`` edges of a task, each node to the smallest that it reaches by them."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def given() -> pa.RecordBatch:
            node, least = smallest_reachable(*(np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["u", "v"]).filter(pa.array(node != least))

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - n))
                batch, n = batch.slice(most - n), n + held[-1].num_rows
                if n == most:
                    yield given()
                    held, n = [], 0
        if n:
            yield given()

    return edges.mapInArrow(contract, "u bigint, v bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b: bigint); comp is the smallest node reachable.

    Alternating large and small stars: each round links the larger neighbours
    of a node to its smallest one, then the smaller. A round needs no node's
    neighbours in one place, and some log n rounds suffice. Each round's edges are
    written to the shared folder. Loops and repeated edges are harmless.

    Before the rounds tasks contract up to ``EDGES`` edges at a time; where that has taken all of them, no round is left to do.
    """
    e = materialise(edges.filter("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    parts = -(-e.count() // EDGES)
    e = materialise(_contracted(e.coalesce(max(1, parts)), EDGES))
    if parts <= 1:
        return e.selectExpr("u as node", "v as comp").union(e.selectExpr("v as node", "v as comp").distinct())
    mark = None
    while True:
        both = e.selectExpr("u as x", "v as y").union(e.selectExpr("v as x", "u as y"))
        least = materialise(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = both.filter("y > x").join(least, "x").selectExpr("y as u", "m as v").distinct()
        large = materialise(large)
        to = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(to, "u").filter("v <> m").selectExpr("v as u", "m as v").union(to.selectExpr("u", "m as v")).distinct()
        e = materialise(small)
        now = e.agg(F.count("*"), F.sum(F.expr("pmod(xxhash64(u, v), 1000000007)"))).first()
        if now == mark:
            return e.selectExpr("u as node", "v as comp").union(e.selectExpr("v as node", "v as comp").distinct())
        mark = now


def slot(values: np.ndarray) -> np.ndarray:
    return (mix(values) & np.uint64(COUNTERS - 1)).astype(np.int64)


def sketch_rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The slabs of a task's counters that are not all zero."""
    for i in range(0, len(counts), SLAB):
        part = counts[i : i + SLAB]
        if part.any():
            yield i // SLAB, zlib.compress(part.astype("<i8").tobytes(), 1)


def sketch_batch(counts: np.ndarray) -> pa.RecordBatch:
    rows = list(sketch_rows(counts))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slab", "counts"])


def summed_sketch(rows: DataFrame, length: int = COUNTERS) -> np.ndarray:
    """The sum of ``length`` counters given by tasks as rows (slab, counts); its size doesn't depend on the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), "<i8")
                total[i] = total[i] + part if i in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slab", "counts"])

    out = np.zeros(length, np.int64)
    for i, raw in rows.repartition("slab").mapInArrow(add, SKETCH_SCHEMA).collect():
        part = np.frombuffer(zlib.decompress(raw), "<i8")
        out[i * SLAB : i * SLAB + len(part)] += part
    return out


def ids_sketch(ids: DataFrame) -> np.ndarray:
    """Which slots the values of a bigint column take; a set of bounded size that may hold more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            counts[slot(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))] = 1
        yield sketch_batch(counts)

    return summed_sketch(ids.na.drop().mapInArrow(count, SKETCH_SCHEMA)) > 0
