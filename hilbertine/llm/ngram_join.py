"""N-gram Jaccard self-join by a token-group matrix.

Documents with equal sets of shingles form a class, and classes are joined.

1. Order. A counting sketch of all shingles gives one global order, rare
   shingles first. Two sets of Jaccard similarity t or more share a shingle
   among the first |s| - ceil(t |s|) + 1 of each (its prefix), in any such order.
2. Groups. Each prefix shingle names as a pivot the class that shares most of its
   prefix. A class forms a group with the pivot that it shares most with.
   Classes are compared with such pivots first, so that a large group of
   near copies costs one comparison for each member. What is linked then needs
   no further comparison within itself.
3. Matrix. The token-group matrix holds, for each group (a chunk of bounded size
   of it) and each prefix shingle, that a member has it. Shingles of linked
   classes only are left out. A query's shingles are joined with the matrix; the
   number of hits bounds the overlap with any member, and only groups where the
   bound allows the similarity are opened. There, the query is compared with the
   group's union and, if that bound holds too, with the members, exactly and
   at once, by counting over the group's shingles.
4. Components of the links are the result.

No step holds the members of a group, the owners of a shingle or the links in
one place, and sets are compared as streams against a group chunk of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linking import COUNTERS, SKETCH_SCHEMA, connected_components, ids_sketch, sketch_rows, slot, summed_sketch
from .scratch import materialise
from .text import U64, shingle_sets

#: Shingles of one group chunk, and of the queries that one task compares with it in a row.
CHUNK_SHINGLES = 100_000
#: Occurrences in the sketch from which on a shingle's classes are dealt over ``SALTS`` tasks.
HOT, SALTS = 8192, 64


def _class_of(shingles: np.ndarray) -> int:
    """A set's 64-bit identity: the wrapped sum of its hashes."""
    return int(shingles.sum(dtype=U64).astype(np.int64)) if len(shingles) else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _text_key(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _sets_and_sketch(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, size, cls) of each document, and the tasks' sketches of all shingles (slab, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        pending: list[np.ndarray] = []
        names = ["doc_id", "text_key", "size", "cls", "slab", "counts"]
        for batch in batches:
            sizes, classes = [], []
            for _, s in shingle_sets(batch.column(1), n):
                sizes.append(len(s))
                classes.append(_class_of(s))
                pending.append(s)
                if len(pending) == 512:
                    counts += np.bincount(slot(np.concatenate(pending)), minlength=COUNTERS)
                    pending = []
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if pending:
            counts += np.bincount(slot(np.concatenate(pending)), minlength=COUNTERS)
        rows = list(sketch_rows(counts))
        k = len(rows)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(4)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names)

    return _texts(docs).withColumn("text_key", _text_key("text")).mapInArrow(scan, f"doc_id bigint, text_key bigint, size bigint, cls bigint, {SKETCH_SCHEMA}")


def _prefixes(docs: DataFrame, n: int, t: int, counts: np.ndarray) -> DataFrame:
    """(token, cls, size, hot) for each prefix shingle; one that the sketch shows to be in one document is left out."""
    hot_from = HOT
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how_many = counts.value
        done: set[int] = set()  # classes that this task has seen
        for batch in batches:
            tokens, classes, sizes, hot, ready = [], [], [], [], 0
            for _, s in shingle_sets(batch.column(1), n):
                c = _class_of(s)
                if not len(s) or c in done:
                    continue
                done.add(c)
                often = how_many[slot(s)]
                first = s[np.lexsort((s, often))[: len(s) - -(-t * len(s) // 100) + 1]]
                first = first[how_many[slot(first)] > 1]
                tokens.append(first)
                classes.append(np.full(len(first), c, np.int64))
                sizes.append(np.full(len(first), len(s), np.int64))
                hot.append(how_many[slot(first)] >= hot_from)
                ready += len(first)
                if ready > 1 << 18:
                    yield _batch(tokens, classes, sizes, hot)
                    tokens, classes, sizes, hot, ready = [], [], [], [], 0
            if tokens:
                yield _batch(tokens, classes, sizes, hot)

    def _batch(tokens: list, classes: list, sizes: list, hot: list) -> pa.RecordBatch:
        columns = [np.concatenate(tokens).view(np.int64), np.concatenate(classes), np.concatenate(sizes), np.concatenate(hot)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "cls", "size", "hot"])

    return _texts(docs).mapInArrow(scan, "token bigint, cls bigint, size bigint, hot boolean")


def _salt() -> Column:
    """The task of its token that a class goes to."""
    return F.when(F.col("hot"), F.pmod("cls", F.lit(SALTS))).otherwise(0).cast("int")


def _salts(rows: DataFrame) -> DataFrame:
    """``rows`` (hot, ...), a hot token's ones once for each of its tasks."""
    return rows.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def _over_token(rows: DataFrame, *aggregates: tuple[str, Column]) -> DataFrame:
    """``rows`` (token, cls, hot, ...) with named least or largest values over all rows of a token.

    Rows of a hot token are never in one task: their values are combined where they stand, and joined back by token and salt.
    """
    by_token = Window.partitionBy("token")
    cold, hot = rows.filter("not hot"), rows.filter("hot")
    found = hot.groupBy("token").agg(*(a.alias(name) for name, a in aggregates)).withColumn("hot", F.lit(True))
    back = hot.withColumn("salt", _salt()).join(_salts(found).drop("hot"), ["token", "salt"]).drop("salt")
    return cold.select("*", *(a.over(by_token).alias(name) for name, a in aggregates)).unionByName(back)


def _least_hits(x: str, y: str, t: int) -> str:
    """SQL for how many prefix shingles sets of sizes x and y share at least, if they are similar.

    Their overlap is at least t / (1 + t) * (x + y), and of it no more than the
    rest of the larger prefix's set lies outside the prefixes.
    """
    return f"((({t} * (({x}) + ({y})) + {99 + t}) div {100 + t}) - (({t} * greatest({x}, {y}) + 99) div 100) + 1)"


def _least_hits_of_any(x: str, near: str, far: str, t: int) -> str:
    """SQL for the least of ``_least_hits`` over all sizes y from near to far.

    Up to x it doesn't fall as y grows, so that near has the least. Beyond, it falls by
    t^2 / (100 (100 + t)) a size but for two roundings of less than 1, so that
    only the last sizes, on which that makes 2, can have it.
    """
    last = 200 * (100 + t) // (t * t) + 1
    return f"least({_least_hits(x, near, t)}, array_min(transform(sequence(greatest({near}, {far} - {last}L), {far}), y -> {_least_hits(x, 'y', t)})))"


class _Chunk:
    """The members of a group chunk: their shingles in order, each with its owner."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]) -> None:
        tokens = np.concatenate([s for _, _, s in members])
        owner = np.repeat(np.arange(len(members)), [len(s) for _, _, s in members])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.cls, self.comp, self.size = np.array([m[0] for m in members]), [m[1] for m in members], np.array([len(m[2]) for m in members])

    def similar(self, s: np.ndarray, t: int) -> np.ndarray:
        """Members whose similarity with the set is t hundredths or more."""
        low, high = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        if 100 * int((high > low).sum()) < t * len(s):  # the overlap with the union
            return np.zeros(0, np.int64)
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.size))
        return np.flatnonzero((100 + t) * common >= t * (self.size + len(s)))


def _compare(docs: DataFrame, classes: DataFrame, need: DataFrame, n: int, t: int) -> DataFrame:
    """Links (a, b) between the queries (role 1) and the members (role 0) of each chunk (grp, salt).

    ``need``: (grp, salt, role, cls, comp). Of the links that a chunk shows, enough
    are given to connect the components (comp) that they connect.
    """
    need = materialise(need.join(classes.selectExpr("cls", "rep as need_id"), "cls"))
    wanted = docs.sparkSession.sparkContext.broadcast(ids_sketch(need.select("need_id")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(wanted.value[slot(ids)]))

    texts = _texts(docs).mapInArrow(pick, "doc_id bigint, text string")
    sent = texts.join(need, F.col("doc_id") == F.col("need_id")).select("grp", "salt", "role", "cls", "comp", "text")
    dealt = sent.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role", "cls")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, chunk, last = None, [], None, None
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for batch in batches:
            a, b = [], []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            for i, s in shingle_sets(batch.column(5), n):
                grp, salt, role, cls, comp = keys[i]
                if (grp, salt) != now:
                    now, members, chunk, last = (grp, salt), [], None, None
                    root.clear()
                if _class_of(s) != cls or (role, cls) == last:
                    continue
                last = (role, cls)
                if role == 0:
                    members.append((cls, comp, s))
                    continue
                if not members:
                    continue
                if chunk is None:
                    chunk = _Chunk(members)
                for m in chunk.similar(s, t).tolist():
                    x, y = find(comp), find(chunk.comp[m])
                    if x != y:
                        root[x] = y
                        a.append(cls)
                        b.append(int(chunk.cls[m]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return materialise(dealt.mapInArrow(verify, "a bigint, b bigint"))


def _components(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_key, size, cls) of each row; (cls, rep, copies) of each class; (cls, comp) of each class that is linked."""
    t = round(100 * threshold)
    scanned = materialise(_sets_and_sketch(docs, n))
    rows = scanned.filter("slab is null").select("doc_id", "text_key", "size", "cls")
    counts = summed_sketch(scanned.filter("slab is not null").select("slab", "counts"))
    classes = materialise(rows.filter("size > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))

    # a shingle of one class alone is left out; of hot ones such as copies have a few stay, which is harmless
    here = Window.partitionBy("token", "salt")
    shared = materialise(
        _prefixes(docs, n, t, counts).withColumn("salt", _salt()).withColumn("lo", F.min("cls").over(here)).withColumn("hi", F.max("cls").over(here))
        .filter("hot or lo < hi").select("token", "salt", "cls", "size", "hot").distinct().drop("salt")
    )
    # the class with fewest shingles of its own is the likeliest centre of its kin
    own = materialise(shared.groupBy("cls", "size").agg(F.count("*").alias("n")).selectExpr("cls", f"cast(round(1000000 * n / (size - ({t} * size + 99) div 100 + 1)) as int) as mark"))
    marked = shared.join(own.select("cls", "mark"), "cls")
    named = _over_token(marked, ("best", F.max(F.struct("mark", "cls", "size")))).selectExpr("cls", "size", "best.cls as pivot", "best.size as pivot_size")
    to_pivot = materialise(
        named.filter(f"cls <> pivot and 100 * least(size, pivot_size) >= {t} * greatest(size, pivot_size)")
        .groupBy("cls", "size", "pivot", "pivot_size").agg(F.count("*").alias("hits"))
    )
    pairs = to_pivot.filter(f"hits >= {_least_hits('size', 'pivot_size', t)}").select("cls", "size", "pivot")
    salts = materialise(pairs.groupBy("pivot").agg((F.floor(F.sum("size") / CHUNK_SHINGLES) + 1).cast("int").alias("salts")))
    need = (
        pairs.join(salts, "pivot").select(F.col("pivot").alias("grp"), F.pmod(F.xxhash64("cls"), "salts").cast("bigint").alias("salt"), F.lit(1).alias("role"), "cls", F.col("cls").alias("comp"))
        .union(salts.select(F.col("pivot").alias("grp"), F.explode(F.expr("sequence(0L, salts - 1L)")).alias("salt"), F.lit(0).alias("role"), F.col("pivot").alias("cls"), F.col("pivot").alias("comp")))
    )
    links = _compare(docs, classes, need, n, t)
    grouped = materialise(connected_components(links))

    linked_as = grouped.selectExpr("node as cls", "comp")
    owned = shared.join(linked_as, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    several = materialise(_over_token(owned, ("lo", F.min("comp")), ("hi", F.max("comp"))).filter("lo < hi").drop("lo", "hi"))
    kin = to_pivot.groupBy("cls").agg(F.max(F.struct("hits", "pivot")).getField("pivot").alias("grp"))
    members = materialise(several.select("cls", "size", "comp").distinct().join(kin, "cls", "left").withColumn("grp", F.coalesce("grp", "cls")))
    chunks = materialise(members.groupBy("grp").agg((F.floor(F.sum("size") / CHUNK_SHINGLES) + 1).cast("int").alias("chunks")))
    members = materialise(members.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks").cast("int")).drop("chunks"))
    matrix = (
        several.select("token", "cls", "hot").join(members, "cls").groupBy("token", "hot", "grp", "chunk")
        .agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("first")).withColumnRenamed("token", "m_token")
    )
    # of a pair, the class with the larger identity is the query
    asking, asked = several.withColumn("salt", _salt()), _salts(matrix).drop("hot").withColumnRenamed("salt", "m_salt")
    ask = asking.join(asked, F.expr(f"token = m_token and salt = m_salt and cls > first and not (lo = comp and hi = comp) and 100 * high >= {t} * size and 100 * size >= {t} * low"))
    near, far = f"greatest(low, ({t} * size + 99) div 100)", f"least(high, (100 * size) div {t})"
    opened = materialise(
        ask.groupBy("cls", "size", "comp", "grp", "chunk").agg(F.count("*").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter(f"hits >= {_least_hits_of_any('size', near, far, t)}").select("cls", "size", "comp", "grp", "chunk")
    )
    # a chunk is sent to as many tasks as its queries need
    tasks = materialise(opened.groupBy("grp", "chunk").agg((F.floor(F.sum("size") / (4 * CHUNK_SHINGLES)) + 1).cast("int").alias("salts")))
    place = "cast(salt * 1000000L + chunk as bigint)"
    need = (
        opened.join(tasks, ["grp", "chunk"]).withColumn("salt", F.pmod(F.xxhash64("cls"), "salts")).select("grp", F.expr(place).alias("salt"), F.lit(1).alias("role"), "cls", "comp")
        .union(members.join(tasks, ["grp", "chunk"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).select("grp", F.expr(place).alias("salt"), F.lit(0).alias("role"), "cls", "comp"))
    )
    more = _compare(docs, classes, need, n, t)
    final = connected_components(grouped.selectExpr("node as a", "comp as b").union(more))

    return rows, classes, materialise(final.withColumnsRenamed({"node": "cls"}))


def jaccard_components(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Components of documents whose sets of ``n``-word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns one row per row of ``docs`` (doc_id, text): doc_id, n_shingles
    (size of its set) and component_id, the smallest doc_id reachable by links.
    Words are runs of anything but blanks, A-Z lower-cased; a text of
    fewer than ``n`` words has its whole sequence as its one shingle. A
    text that is null or has no words has an empty set and is linked with
    nothing. Equal sets are linked. Rows that repeat a doc_id take part each
    with their own text; null doc_ids are passed over in the minimum. An
    empty table gives no rows; other columns are not used. ``threshold`` counts in hundredths.
    """
    rows, classes, linked = _components(docs, n, threshold)
    named = materialise(linked.join(classes, "cls"))
    smallest = materialise(named.groupBy("comp").agg(F.min("rep").alias("component_id")))
    into = named.join(smallest, "comp").select("cls", "component_id")
    copies = classes.filter("copies > 1").join(into, "cls", "left_anti").selectExpr("cls", "rep as component_id")
    into = materialise(into.union(copies))
    return rows.join(into, (rows["cls"] == into["cls"]) & (rows["size"] > 0), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component; all columns are kept.

    The row with the smallest doc_id stays, a null one counting as the largest, and of several texts
    under it the one with the smallest hash. The documents without words are linked with
    nothing and stay. Rows that repeat both doc_id and text stay or go alike. An empty table gives an empty one.
    """
    rows, classes, linked = _components(docs, n, threshold)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    several = linked.select("cls", "comp").union(classes.filter("copies > 1").join(linked, "cls", "left_anti").selectExpr("cls", "cls as comp"))
    placed = materialise(rows.filter("size > 0").join(several, "cls").select("comp", place.alias("place")))
    first = placed.groupBy("comp").agg(F.min("place").alias("first"))
    drop = materialise(placed.join(first, "comp").filter("place <> first").select(F.struct("place.doc_id", "place.text_key").alias("gone")).distinct())
    whole = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & (_text_key("doc.text") == F.col("gone.text_key"))
    return whole.join(drop, same, "left_anti").select("doc.*")
