"""Three-dimensional Hilbert keys.

The curve is built from one rule. Its octants are visited along a Gray path, and the
curve within each is the whole one, turned or mirrored; the 24 orientations that
arise are the states. Two levels are looked up at a time, in a table short enough that
plans that hold it many times over stay small; all lookups stay inside generated code.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 21
CELLS = 1 << BITS
#: Levels of one lookup: its table is a literal in every plan that keys rows, and 8 times as long with each level more (1,536 numbers at 2, 12,288 at 3).
STEP = 2
#: Shifts and masks that move the bits of a 21-bit number three places apart.
SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]

# Octants (x, y, z) in the order in which the curve visits them, and how the
# curve within each is turned: which axis each coordinate is taken from, and which are mirrored.
PATH = [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (0, 1, 1), (0, 0, 1)]
TURNS = [
    ((0, 2, 1), (0, 0, 0)), ((2, 1, 0), (0, 0, 0)), ((2, 1, 0), (0, 0, 0)), ((0, 1, 2), (1, 1, 0)),
    ((0, 1, 2), (1, 1, 0)), ((2, 1, 0), (1, 0, 1)), ((2, 1, 0), (1, 0, 1)), ((0, 2, 1), (0, 1, 1)),
]

Turn = tuple[tuple[int, ...], tuple[int, ...]]


def _applied(turn: Turn, p: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(p[a] ^ m for a, m in zip(*turn, strict=True))


def _after(outer: Turn, inner: Turn) -> Turn:
    """The turn that applies ``inner`` and then ``outer``."""
    axes = tuple(inner[0][a] for a in outer[0])
    mirrors = tuple(inner[1][a] ^ m for a, m in zip(*outer, strict=True))
    return axes, mirrors


@cache
def state_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, rank) for each state and octant 4 x + 2 y + z; state 0 is the curve as it stands."""
    first: Turn = ((0, 1, 2), (0, 0, 0))
    order, place = [first], {first: 0}
    follow, rank = [], []
    for turn in order:
        row_next, row_rank = [0] * 8, [0] * 8
        for r, (p, t) in enumerate(zip(PATH, TURNS, strict=True)):
            x, y, z = _applied(turn, p)
            inner = _after(turn, t)
            if inner not in place:
                place[inner] = len(order)
                order.append(inner)
            row_next[4 * x + 2 * y + z], row_rank[4 * x + 2 * y + z] = place[inner], r
        follow.append(row_next)
        rank.append(row_rank)
    return np.array(follow), np.array(rank)


@cache
def _stepped(levels: int = STEP) -> list[int]:
    """Entry state * 8^levels + interleaved octants -> next state * 8^levels + ranks."""
    follow, rank = state_tables()
    size = 8**levels
    state, ranks = np.repeat(np.arange(len(follow)), size), np.zeros(len(follow) * size, np.int64)
    octants = np.tile(np.arange(size), len(follow))
    for level in range(levels - 1, -1, -1):
        o = octants >> (3 * level) & 7
        ranks = ranks * 8 + rank[state, o]
        state = follow[state, o]
    return (state * size + ranks).tolist()


def hilbert_key_numpy(x: np.ndarray, y: np.ndarray, z: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of integer coordinates, of which the lowest ``bits`` count (0: key 0; more than 21: 21)."""
    bits = min(max(bits, 0), BITS)
    follow, rank = state_tables()
    key, state = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        o = (x >> b & 1) * 4 + (y >> b & 1) * 2 + (z >> b & 1)
        key = key * 8 + rank[state, o]
        state = follow[state, o]
    return key


def with_hilbert_key(df: DataFrame, out: str = "key", x: str = "x", y: str = "y", z: str = "z", bits: int = BITS) -> DataFrame:
    """``df`` with the Hilbert key of three bigint columns, of which the lowest ``bits`` count.

    The axes' bits are interleaved first by masks and shifts, so that a level's octant is one shift: generated code
    stays below the size beyond which the JVM leaves a method uncompiled.
    """
    bits = min(max(bits, 0), BITS)
    if not bits:
        return df.withColumn(out, F.lit(0).cast("long"))
    axes = [f"__{out}_{i}" for i in "xyz"]
    df = df.select("*", *[F.expr(f"cast({c} as bigint) & {CELLS - 1}L").alias(a) for c, a in zip((x, y, z), axes, strict=True)])
    for by, mask in SPREAD:
        df = df.withColumns({a: F.expr(f"({a} | shiftleft({a}, {by})) & {mask}L") for a in axes})
    mixed, table, names, at = f"__{out}_mixed", {}, [], bits
    df = df.withColumn(mixed, F.expr(f"shiftleft({axes[0]}, 2) | shiftleft({axes[1]}, 1) | {axes[2]}")).drop(*axes)
    while at:
        levels = min(STEP, at)
        at -= levels
        if levels not in table:
            # one literal, which is parsed once when constants are folded
            table[levels] = f"cast(split('{','.join(map(str, _stepped(levels)))}', ',') as array<int>)"
        octants = f"cast(shiftright({mixed}, {3 * at}) & {8**levels - 1}L as int)"
        # an entry's lowest bits are ranks, those above them the state
        state = f"shiftleft(shiftright({names[-1][0]}, {3 * names[-1][1]}), {3 * levels}) | " if names else ""
        name = f"__{out}_{len(names)}"
        df = df.withColumn(name, F.expr(f"get({table[levels]}, {state}{octants})"))
        names.append((name, levels))
    parts, at = [], bits
    for name, levels in names:
        at -= levels
        parts.append(f"shiftleft(cast({name} & {8**levels - 1} as bigint), {3 * at})")
    return df.withColumn(out, F.expr(" | ".join(parts))).drop(mixed, *[n for n, _ in names])


def hilbert_sql(source: str, carried: str, bits: int = BITS) -> str:
    """Common table expressions ``hilbert_walk`` and ``hilbert_keyed`` in plain SQL: ``carried`` columns and key.

    One row and level at a time; for engines without the lookup above. Goes after WITH RECURSIVE.
    """
    follow, rank = state_tables()
    octant = "cast(((x >> b) & 1) * 4 + ((y >> b) & 1) * 2 + ((z >> b) & 1) as bigint)"
    pick = lambda t: f"([{', '.join(map(str, t.ravel().tolist()))}])[state * 8 + {octant} + 1]"
    return (
        f"hilbert_walk as (select {carried}, {bits - 1} as b, 0 as state, cast(0 as bigint) as key from {source} "
        f"union all select {carried}, b - 1, {pick(follow)}, key * 8 + {pick(rank)} from hilbert_walk where b >= 0), "
        f"hilbert_keyed as (select {carried}, key from hilbert_walk where b = -1)"
    )


