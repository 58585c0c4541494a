"""Repair of the structure of conversations: the cheapest edits that make roles follow a grammar.

A conversation is repaired if its roles' initials are none at all, or one ``s`` at most and then ``ua`` once or more. The
four states of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn (or nothing: the ends).

Rows (conv_id, turn, role, text) count in the order of turn, nulls first, then role, then text, which settles ties. A null role or
text is one space; a role with another initial than s, u or a can't be kept. A null ``conv_id`` is a conversation like others;
repeated rows are duplicates to be deleted; extra columns are not read; empty tables give empty results.

One task goes through a conversation's rows in order, as the dynamic programme and SHA-256 demand. Spark sorts
the rows (on disk beyond its memory); the task holds one batch of them, four states and the audits, which take
a letter a row. Conversations of any length and texts of any length take the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Turns that may be made, by changing a role or inserting one: into a user's from these states, into an assistant's from this.
MADE = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
#: Rows after which the audits so far are set aside.
SETTLE = 256

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AUDIT_SCHEMA = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"
REPAIRED_SCHEMA = "conv_id long, place long, turn long, role string, text string, edit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that CRC-32 of ``conv_id:turn`` deals: a row lost, emptied, without stops, repeated, or of role user."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.expr("explode(array_repeat(0, case __kind when 0 then 0 when 3 then 2 else 1 end))")
    return rows.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


class Layer:
    """For each state: the least (cost, audit) of all ways to edit the rows so far into it.

    An audit is a settled part and a tail. Settled parts end in the same row's letter, so that none begins another and
    their ranks alone order them; comparing two audits costs no more than their tails. Of two audits of one cost and as many
    rows none begins the other, either, so that the lesser stays the lesser whatever follows.
    """

    def __init__(self) -> None:
        self.at: list = [(0, 0, "", None), None, None, None]  # (cost, rank, tail, (settled part before, letters))
        self.rows = 0
        self._insert()

    def _insert(self) -> None:
        """Close the layer: at most two turns are inserted at one place, for more would come back to a state at a cost."""
        for s, t in MADE:
            self._offer(self.at, self.at[s], t, INSERT, "I")

    @staticmethod
    def _offer(layer: list, way, to: int, cost: int, letter: str) -> None:
        if way is not None:
            new = (way[0] + cost, way[1], way[2] + letter, way[3])
            if layer[to] is None or new[:3] < layer[to][:3]:
                layer[to] = new

    def row(self, initial: str, fault: str) -> None:
        """One more row, with its fault: '', 'blank', 'duplicate' or 'truncated'."""
        new: list = [None] * 4
        for s, way in enumerate(self.at):
            self._offer(new, way, s, DELETE, "D")
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault else 0
            for s, way in enumerate(self.at):
                if (initial, s) in KEPT:
                    self._offer(new, way, KEPT[initial, s], more, "K")
            for s, t in MADE:
                self._offer(new, self.at[s], t, REROLE + more, "R")
        self.at = new
        self.rows += 1
        if self.rows % SETTLE == 0:
            self._settle()
        self._insert()

    def _settle(self) -> None:
        bodies = {(way[1], way[2]): way[3] for way in self.at if way}  # the layer is not closed: tails end in the row's letter
        ranks = {key: i for i, key in enumerate(sorted(bodies))}
        nodes = {key: (before, key[1]) for key, before in bodies.items()}
        self.at = [way and (way[0], ranks[way[1:3]], "", nodes[way[1:3]]) for way in self.at]

    def best(self) -> tuple[int, str]:
        cost, _, tail, node = min((way for way in (self.at[START], self.at[ASSISTANT]) if way), key=lambda w: w[:3])
        parts = [tail]
        while node:
            node, letters = node
            parts.append(letters)
        return cost, "".join(reversed(parts))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Rows as tuples, and whether each begins another conversation (the first column) than the one before."""
    last: tuple | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                yield last != row[:1], row
                last = row[:1]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in text.split(", "))])


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def audit_conversations(rows: DataFrame) -> DataFrame:
    """For each conversation of ``rows``: conv_id, gaps, counts of faults, illegal, cost and audit of its cheapest repair.

    A row's first fault counts: blank, duplicate (role and text seen before), truncated (doesn't end in a stop). Edits by
    letter: Keep, Rerole, Delete, Insert; of cheapest ones that with the ASCII-least audit is taken.
    """
    dealt = _clean(rows).repartition("conv_id")  # all that follows stays in this partitioning
    same = Window.partitionBy("conv_id", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).orderBy(F.asc_nulls_first("turn"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("__seen"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    marked = dealt.withColumn("__seen", F.row_number().over(same) > 1).withColumn("__fault", fault)
    ordered = marked.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "__seen")
    narrow = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), F.col("__fault").alias("fault"))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            layer = None

            def result() -> tuple:
                gaps = 0 if turns[0] is None else turns[1] - turns[0] + 1 - turns[2]
                return (who, gaps, *faults.values(), illegal, *layer.best())

            for begins, (conv, turn, initial, fault) in _grouped(batches):
                if begins:
                    if layer:
                        yield result()
                    layer, faults, illegal, turns, before, who = Layer(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, (None, None, 0), None, conv
                elif before + initial not in LEGAL:
                    illegal += 1
                if fault:
                    faults[fault] += 1
                if turn is not None:  # in order, so that a new turn is a greater one
                    turns = (turn if turns[0] is None else turns[0], turn, turns[2] + (turn != turns[1]))
                layer.row(initial, fault)
                before = initial

            if layer:
                yield result()

        yield from _batches(results(), _schema(AUDIT_SCHEMA))

    return narrow.mapInArrow(audit, AUDIT_SCHEMA)


def repair_conversations(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), turn (null if inserted), role, text (empty if inserted) and edit (K, R or I).

    ``audits`` (conv_id, audit) as ``audit_conversations`` gives them for the same rows. A conversation's
    turns leave one task in the order of their places.
    """
    turns = _clean(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "text")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            who, letters, at, place, state = None, "", 0, 0, START

            def inserted() -> Iterator[tuple]:
                nonlocal at, place, state
                while letters[at : at + 1] == "I":
                    state = ASSISTANT if state == USER else USER
                    yield who, place, None, ROLES[state], "", "I"
                    at, place = at + 1, place + 1

            for _, (conv, kind, turn, role, text, audit) in _grouped(batches):
                if not kind:
                    yield from inserted()  # at the end of the conversation before
                    who, letters, at, place, state = conv, audit, 0, 0, START
                    continue
                yield from inserted()
                edit, at = letters[at], at + 1
                if edit == "D":
                    continue
                state = KEPT[role[:1], state] if edit == "K" else ASSISTANT if state == USER else USER
                yield who, place, turn, role if edit == "K" else ROLES[state], text, edit
                place += 1
            yield from inserted()

        yield from _batches(results(), _schema(REPAIRED_SCHEMA))

    return both.mapInArrow(repair, REPAIRED_SCHEMA)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over the turns' ``role:text`` in the order of their places, joined by newlines."""
    ordered = repaired.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            who, h = None, None
            for begins, (conv, place, role, text) in _grouped(batches):
                if begins:
                    if h:
                        yield who, h.hexdigest()
                    who, h = conv, hashlib.sha256()
                h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if h:
                yield who, h.hexdigest()

        yield from _batches(results(), _schema("conv_id long, repaired_sha256 string"))

    return ordered.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For every ``conv_id`` of ``conversations``: what ``audit_conversations`` and ``digests`` say of ``rows``; zeros, an empty audit and the hash of nothing where it has no rows."""
    audits = materialise(audit_conversations(rows))
    hashes = digests(repair_conversations(rows, audits))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids
    for part, name in ((audits, "__a"), (hashes, "__h")):
        part = part.withColumnRenamed("conv_id", name)
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return out.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
