"""Fuzzy line de-duplication.

Lines are normalised to their words, A-Z lower-cased, and equal ones form a
class. Classes that may be similar meet under keys, those that do are compared by
edit similarity, and of each connected group of lines the first occurrence, by
doc_id and place, stays.

Keys. A counting sketch of all lines' words gives one order, rare words first;
every two of a line's first ``RAREST`` words are a key. So lines meet whose rarest
words are the same but for a few, whatever else differs. Of the pairs that meet, only
those go uncompared whose lengths rule the similarity out. SimHashes under
pigeonhole blocks, the usual keys for this, can't reach the similarity that is asked
for: one word of ten replaced changes some nine of 64 bits.

Comparing. Classes first meet the smallest one under a key, so that a large
group of kin costs one comparison for each member. What these links leave apart
under a key is compared in blocks of bounded size, each pair under the
smallest key that it shares; a large group makes many blocks for many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .editing import similar
from .linking import COUNTERS, SKETCH_SCHEMA, connected_components, ids_sketch, sketch_rows, slot, summed_sketch
from .scratch import materialise
from .text import LOWER, U64, byte_class, mix, runs, word_hashes, words

MIN_WORDS = 5
#: Words of a line, the rarest ones, of which every two are a key.
RAREST = 5
LETTERS = byte_class("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: The ``rarity`` (of 8192 occurrences) from which on a word's keys are not gathered by key in one task.
HOT, SALTS = 8 * 13, 64
#: Classes, and characters of their lines, of one side of a block.
BLOCK_LINES, BLOCK_CHARS = 256, 1 << 20
#: Pairs that are compared side by side.
PAIRS = 4096


def split_wide(data: np.ndarray, line: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with those that hold a character from U+0800 on replaced by their overlapping pairs of characters.

    Scripts without blanks between words would else make one word of a whole line.
    """
    wide = np.zeros(len(start), bool)
    wide[np.searchsorted(start, np.flatnonzero(data >= 0xE0), "right") - 1] = True
    if not wide.any():
        return line, start, end
    ch = np.flatnonzero((data & 0xC0) != 0x80)
    w = np.searchsorted(start, ch, "right") - 1
    inside = (w >= 0) & (ch < end[w]) & wide[w]
    ch, w = ch[inside], w[inside]
    after = np.append(w[1:], -1)  # the word of the next character, and of the one after it
    third, at = np.concatenate([w[2:], [-1, -1]])[: len(w)], np.concatenate([ch[2:], [0, 0]])[: len(w)]
    stop = np.where(third == w, at, end[w])
    first = np.append(True, w[1:] != w[:-1])
    whole = (after == w) | first  # of one character alone, or followed by another
    new_start = np.concatenate([start[~wide], ch[whole]])
    order = np.argsort(new_start, kind="stable")
    return np.concatenate([line[~wide], line[w[whole]]])[order], new_start[order], np.concatenate([end[~wide], stop[whole]])[order]


class _Lines:
    """The lines of a run of texts that have enough words, and their words' hashes.

    row, number: place of the line; begin, stop: its bytes; key: its identity, the hash of
    its words in order; length: code points when normalised; h, of: hash and line of each word.
    """

    def __init__(self, base: int, data: np.ndarray, offsets: np.ndarray, min_words: int) -> None:
        ends = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], ends[ends < len(data) - 1] + 1])).astype(np.int64)
        bounds = np.append(starts, len(data))
        line, start, end = words(data, bounds, LETTERS) if len(starts) else (np.zeros(0, np.int64),) * 3
        letters = np.bincount(line, weights=end - start, minlength=len(starts)).astype(np.int64)
        spaces = np.bincount(line, minlength=len(starts)) - 1
        high = data >= 0x80
        if high.any():
            after = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80, dtype=np.int64)])
            letters -= np.diff(after[bounds])  # bytes that continue a character
            if len(start) and (data >= 0xE0).any():
                line, start, end = split_wide(data, line, start, end)
        count = np.bincount(line, minlength=len(starts))
        keep = np.flatnonzero(count >= min_words)
        chosen = count[line] >= min_words
        h, size = word_hashes(data, start[chosen], end[chosen]), count[keep]
        first = np.cumsum(size) - size
        place = (np.arange(len(h)) - np.repeat(first, size)).astype(U64)
        self.data, self.begin, self.stop = data, starts[keep], bounds[keep + 1]
        self.key = mix(np.add.reduceat(mix(h + mix(place + U64(1))), first)) if len(keep) else np.zeros(0, U64)
        self.length, self.h, self.of = (letters + spaces)[keep], h, np.repeat(np.arange(len(keep)), size)
        row = np.searchsorted(offsets, self.begin, "right") - 1
        self.row = base + row
        self.number = np.searchsorted(ends, self.begin) - np.searchsorted(ends, offsets[row])

    def normal(self, i: int) -> str:
        return " ".join(self.data[self.begin[i] : self.stop[i]].tobytes().translate(_SPACED).decode("utf-8", "replace").split())


_SPACED = bytes(LOWER[i] if LETTERS[i] else 32 for i in range(256))


def _lines(texts: pa.Array, min_words: int) -> Iterator[_Lines]:
    for base, data, offsets in runs(texts):
        found = _Lines(base, data, offsets, min_words)
        if len(found.key):
            yield found


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))


def _occurrences_and_sketch(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, number, line) of each line that has enough words, and the tasks' sketches of its words (slab, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("number", pa.int32()), ("line", pa.int64()), ("slab", pa.int32()), ("counts", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pending, ready = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for x in _lines(batch.column(2), min_words):
                pending.append(slot(x.h))
                ready += len(x.h)
                if ready > COUNTERS:
                    counts += np.bincount(np.concatenate(pending), minlength=COUNTERS)
                    pending, ready = [], 0
                at, k = pa.array(x.row), len(x.row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(x.number.astype(np.int32)), pa.array(x.key.view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        if pending:
            counts += np.bincount(np.concatenate(pending), minlength=COUNTERS)
        rows = list(sketch_rows(counts))
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return _rows(docs).mapInArrow(scan, f"doc_id bigint, text_key bigint, number int, line bigint, {SKETCH_SCHEMA}")


def rarity(counts: np.ndarray) -> np.ndarray:
    """The counters of a sketch in steps of an eighth of a doubling; 0 for words that stand but once."""
    return np.minimum(np.round(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def word_keys(h: np.ndarray, of: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, key, and whether the key may have very many lines, for every two of each line's rarest words by ``rarity``; ``of`` rises.

    A word that the sketch shows to stand but once is in no other line and left out.
    """
    out_line, out, hot = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, bool)]
    for low in range(0, int(of[-1]) + 1 if len(of) else 0, 1 << 24):
        a, b = np.searchsorted(of, [low, low + (1 << 24)])
        how = level[slot(h[a:b])]
        some = how > 0
        v = ((of[a:b] - low).astype(U64)[some] << U64(40)) | (how[some].astype(U64) << U64(32)) | (h[a:b][some] >> U64(32))
        v.sort()
        v = v[np.append(True, v[1:] != v[:-1])] if len(v) else v
        line = (v >> U64(40)).astype(np.int64)
        m = mix(v & U64((1 << 40) - 1))
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(v) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(v)))
        for i, j in combinations(range(RAREST), 2):
            those = first[count > j]
            out_line.append(line[those] + low)
            out.append(mix(m[those + i] + m[those + j]))
            hot.append(((v[those + i] >> U64(32)) & U64(255)) >= HOT)  # a key has no more lines than its rarer word
    return np.concatenate(out_line), np.concatenate(out), np.concatenate(hot)


def _keys(docs: DataFrame, min_words: int, counts: np.ndarray) -> DataFrame:
    """(line, length, part, hot): the keys of each class and its length when normalised. A task gives a class once."""
    level = docs.sparkSession.sparkContext.broadcast(rarity(counts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for x in _lines(batch.column(2), min_words):
                fresh = np.zeros(len(x.key), bool)
                for i, key in enumerate(x.key.tolist()):
                    if key not in done:
                        done.add(key)
                        fresh[i] = True
                line, part, hot = word_keys(x.h[fresh[x.of]], x.of[fresh[x.of]], level.value)
                yield pa.RecordBatch.from_arrays([pa.array(x.key[line].view(np.int64)), pa.array(np.minimum(x.length[line], 2**31 - 1).astype(np.int32)), pa.array(part.view(np.int64)), pa.array(hot)], names=["line", "length", "part", "hot"])

    return _rows(docs).mapInArrow(scan, "line bigint, length int, part bigint, hot boolean")


def _line_texts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(line, norm) for the classes in ``wanted`` (line)."""
    slots = docs.sparkSession.sparkContext.broadcast(ids_sketch(wanted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for x in _lines(batch.column(2), min_words):
                lines, texts = [], []
                for i in np.flatnonzero(slots.value[slot(x.key)]).tolist():
                    if (key := int(x.key[i])) not in done:
                        done.add(key)
                        lines.append(x.key[i])
                        texts.append(x.normal(i))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(lines, U64).view(np.int64)), pa.array(texts, pa.string())], names=["line", "norm"])

    found = _rows(docs).mapInArrow(scan, "line bigint, norm string")
    return found.join(wanted, "line", "left_semi").groupBy("line").agg(F.min("norm").alias("norm"))


def _near(x: str, y: str, similarity: float) -> str:
    """SQL: whether the lengths allow the similarity."""
    return f"abs({x} - {y}) <= floor({1 - similarity} * greatest({x}, {y}) + 1e-9)"


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose normalised lines (line, norm) have the edit similarity."""
    both = pairs.join(texts.selectExpr("line as a", "norm as na"), "a").join(texts.selectExpr("line as b", "norm as nb"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                some = batch.slice(at, PAIRS)
                kept = similar(some.column(2).to_pylist(), some.column(3).to_pylist(), similarity)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["a", "b"]).filter(pa.array(kept))

    return materialise(both.select("a", "b", "na", "nb").mapInArrow(verify, "a bigint, b bigint"))


def _links_in_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes of one block (part, block) that are not of one component.

    ``rows``: (part, block, side, line, comp, pivot, norm, parts), side being its chunk and parts the keys that the
    class has here, in order. A pair is compared under the first key it shares, and not
    with the pivot of that key, which has been compared. Of a block's links enough
    are given to connect what they connect.
    """

    def close(pairs: list[tuple]) -> Iterator[tuple[int, int]]:
        hits = similar([x[4] for x, _ in pairs], [y[4] for _, y in pairs], similarity)
        root: dict = {}

        def find(k: tuple) -> tuple:
            while root.get(k, k) != k:
                k = root[k]
            return k

        for k in np.flatnonzero(hits).tolist():
            x, y = pairs[k]
            u, v = find((x[:2], x[3])), find((y[:2], y[3]))
            if u != v:
                root[u] = v
                yield x[2], y[2]

    def candidates(group: list[tuple]) -> Iterator[tuple]:
        group.sort(key=lambda x: len(x[4]))
        for i, x in enumerate(group):
            most = (len(x[4]) + 1e-9) / similarity
            for y in group[i + 1 :]:
                if len(y[4]) > most:
                    break
                if x[3] != y[3] and (x[1] <= 0 or x[7] != y[7]) and x[6] != x[2] and x[6] != y[2] and x[5].isdisjoint(y[5]):
                    yield x, y

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pairs, last = [], [], None
        for batch in batches:
            links = []
            for part, block, side, line, comp, pivot, norm, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, block) != last:
                    for pair in candidates(group):
                        pairs.append(pair)
                        if len(pairs) >= PAIRS:
                            links += close(pairs)
                            pairs = []
                    group, last = [], (part, block)
                if not group or group[-1][2] != line:  # [5]: the keys before this one
                    group.append((part, block, line, comp, norm, frozenset(parts[: parts.index(part)]), pivot, side))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
        links = []
        for pair in candidates(group):
            pairs.append(pair)
            if len(pairs) >= PAIRS:
                links += close(pairs)
                pairs = []
        links += close(pairs) if pairs else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    dealt = rows.select("part", "block", "side", "line", "comp", "pivot", "norm", "parts").repartition("part", "block").sortWithinPartitions("part", "block", "line")
    return materialise(dealt.mapInArrow(compare, "a bigint, b bigint"))


def _blocks(inner: str, outer: str, is_inner: str, chunk: str) -> str:
    """SQL for the blocks in which a class of a key stands.

    The classes of the pivot's component (inner) are linked already and meet only
    the others (outer); these meet each other, too. Both sides are dealt into chunks. In a block
    above 0 two chunks meet each other, in one up to 0 all of its classes meet.
    """
    return (
        f"if({inner} = 1 and {outer} = 1, array(0L), if({is_inner}, transform(sequence(0L, {outer} - 1), i -> i * {inner} + {chunk} + 1), "
        f"concat(transform(sequence(0L, {inner} - 1), i -> {chunk} * {inner} + i + 1), "
        f"transform(sequence(0L, {outer} - 1), i -> if(i = {chunk}, -i - 1, {inner} * {outer} + least({chunk}, i) * {outer} + greatest({chunk}, i) + 1)))))"
    )


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines, and (line, keep) for each line class of which an occurrence goes.

    keep is the (doc_id, text_key, number) that stays of the class's group.
    """
    scanned = materialise(_occurrences_and_sketch(docs, min_words))
    seen = scanned.filter("slab is null").select("doc_id", "text_key", "number", "line")
    classes = materialise(seen.groupBy("line").agg(F.min(F.struct("doc_id", "text_key", "number")).alias("first"), F.count("*").alias("n")))
    keys = _keys(docs, min_words, summed_sketch(scanned.filter("slab is not null").select("slab", "counts")))
    # the smallest class under a key is its pivot; a key that may be very common is gathered in two steps
    here = Window.partitionBy("part", "salt")
    salted = keys.withColumn("salt", F.when(F.col("hot"), F.pmod("line", F.lit(SALTS))).otherwise(0).cast("int"))
    local = materialise(salted.withColumn("lo", F.min(F.struct("line", "length")).over(here)).withColumn("hi", F.max("line").over(here)).filter("hot or lo.line < hi").drop("salt", "hi"))
    hot = local.filter("hot").select("part", "line", "length")
    pivots = hot.groupBy("part").agg(F.min(F.struct("line", "length")).alias("lo"), F.max("line").alias("hi")).filter("lo.line < hi")
    under = local.filter("not hot").select("part", "line", "length", "lo").union(hot.join(pivots, "part").select("part", "line", "length", "lo"))
    met = materialise(
        under.select("part", "line", "length", F.col("lo.line").alias("pivot"), F.col("lo.length").alias("pivot_length"))
        .filter("line <> pivot").withColumn("near", F.expr(_near("length", "pivot_length", similarity)))
    )
    to_pivot = materialise(met.filter("near").selectExpr("line as a", "pivot as b").distinct())
    # under a key with one class besides the pivot, the pivot settles the only pair
    more = materialise(met.groupBy("part").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.first("pivot").alias("line"), F.first("pivot_length").alias("length")).filter("lo < hi"))
    meeting = met.join(more.select("part"), "part", "left_semi").select("part", "line", "length", "pivot").union(more.selectExpr("part", "line", "length", "line as pivot"))
    # every class that either round may compare
    wanted = materialise(meeting.select("line").union(to_pivot.select("a")).union(to_pivot.select("b")).distinct())
    texts = materialise(_line_texts(docs, wanted, min_words))
    groups = materialise(connected_components(_similar(to_pivot, texts, similarity)).withColumnsRenamed({"node": "line"}))
    of_pivot = groups.selectExpr("line as pivot", "comp as pivot_comp")
    owned = materialise(
        meeting.join(groups, "line", "left").join(of_pivot, "pivot", "left")
        .select("part", "line", "length", "pivot", F.coalesce("comp", "line").alias("comp"), F.expr("coalesce(comp, line) = coalesce(pivot_comp, pivot)").alias("inner")).distinct()
    )
    chunks = lambda side: f"greatest(1L, cast(ceil(greatest(sum(if({side}, 1, 0)) / {BLOCK_LINES}, sum(if({side}, length, 0)) / {BLOCK_CHARS})) as bigint))"
    open_parts = owned.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.expr(chunks("inner")).alias("n_inner"), F.expr(chunks("not inner")).alias("n_outer")).filter("lo < hi").drop("lo", "hi")
    several = materialise(owned.join(open_parts, "part"))
    chunk = "pmod(xxhash64(line), if(inner, n_inner, n_outer))"
    placed = several.select("part", "line", "comp", "pivot", F.expr(f"if(inner, -1L, {chunk})").alias("side"), F.explode(F.expr(_blocks("n_inner", "n_outer", "inner", chunk))).alias("block"))
    with_keys = several.groupBy("line").agg(F.array_sort(F.collect_set("part")).alias("parts")).join(texts, "line")
    found = _links_in_blocks(placed.join(with_keys, "line"), similarity)
    final = connected_components(groups.selectExpr("line as a", "comp as b").union(found))
    linked = materialise(final.withColumnsRenamed({"node": "line"}).join(classes, "line"))
    firsts = materialise(linked.groupBy("comp").agg(F.min("first").alias("keep")))
    of_groups = linked.join(firsts, "comp").select("line", "keep")
    repeated = classes.filter("n > 1").join(linked.select("line"), "line", "left_anti").selectExpr("line", "first as keep")
    return seen, materialise(of_groups.union(repeated))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = 0.8, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with every near-repeated line removed but one of its group.

    All columns are kept; text loses the lines, n_chars (if there) follows, and
    n_lines_dropped is added, in place of a column of that name. Lines end at a line feed.
    Those of fewer than ``min_words`` words are never touched, nor is a text that loses no line; a run of
    characters from U+0800 on counts as its overlapping pairs. A
    null text stays null. Rows that repeat a doc_id with equal texts are
    treated alike. An empty table gives an empty one. With ``drop_emptied``, a document of
    whose text nothing but blanks is left goes; one that had no words before stays.
    """
    seen, groups = line_groups(docs, min_words, similarity)
    gone = seen.join(groups, "line").filter("not (struct(doc_id, text_key, number) <=> keep)")
    drop = materialise(gone.groupBy("doc_id", "text_key").agg(F.collect_set("number").alias("numbers")).select(F.struct("doc_id", "text_key", "numbers").alias("gone")))
    whole = docs.select(F.struct("*").alias("doc"))
    # as many rows as documents with repeated lines: the same join at every size
    met = whole.join(drop.hint("merge"), F.col("doc.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & (F.xxhash64(F.col("doc.text").cast("string")) == F.col("gone.text_key")), "left")
    left = F.expr("array_join(filter(split(cast(doc.text as string), '\\n'), (x, i) -> not array_contains(gone.numbers, i)), '\\n')")
    changed = met.select("doc", "gone", F.when(F.col("gone").isNotNull(), left).alias("rest"))
    if drop_emptied:
        changed = changed.filter("gone is null or rest rlike '[^\\\\x09-\\\\x0D ]'")
    new = {"text": F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.col("rest")).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("doc.n_chars")).otherwise(F.length("rest").cast(kind)).alias("n_chars")
    others = [c for c in docs.columns if c != "n_lines_dropped"]
    return changed.select(*[new.get(c, F.col(f"doc.`{c}`")) for c in others], F.coalesce(F.size("gone.numbers"), F.lit(0)).cast("long").alias("n_lines_dropped"))
