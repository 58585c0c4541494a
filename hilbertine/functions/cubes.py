"""Arithmetic of Hilbert cubes, as SQL text that Spark and other engines read alike.

A cube of level l holds the keys that share their first 3 l bits. Its end could be
2^63, beyond a bigint, so cubes go by their last key instead.
"""

from __future__ import annotations

import math

from .hilbert import BITS, CELLS

LAST_KEY = (1 << 63) - 1


def mask(level: str) -> str:
    """The key bits below a cube of ``level``."""
    return f"(cast({LAST_KEY} as bigint) >> cast(3 * ({level}) as int))"


def prefix(key: str, level: str) -> str:
    return f"(({key}) >> cast({3 * BITS} - 3 * ({level}) as int))"


def key_begin(key: str, level: str) -> str:
    return f"(({key}) - (({key}) & {mask(level)}))"


def key_last(key: str, level: str) -> str:
    return f"(({key}) | {mask(level)})"


def side(level: str) -> str:
    return f"(cast(1 as bigint) << cast({BITS} - ({level}) as int))"


def level_for_side(cells: int) -> int:
    """The least level whose cubes are at most ``cells`` wide; 21 for less than one cell."""
    for level in range(BITS + 1):
        if CELLS >> level <= max(cells, 1):
            return level
    return BITS


def common_level(a: str, b: str) -> str:
    """The deepest level at which two keys share a cube (Spark SQL)."""
    return f"(case when ({a}) = ({b}) then {BITS} else cast(floor((63 - length(bin(({a}) ^ ({b})))) / 3) as int) end)"


def common_level_portable(a: str, b: str) -> str:
    """The same for engines whose exclusive or is a function."""
    return f"(case when ({a}) = ({b}) then {BITS} else cast(floor((63 - length(bin(xor({a}, {b})))) / 3) as int) end)"


def bounds(target: int, tolerance: float) -> tuple[int, int]:
    """Least and most rows of a leaf: target times one minus and plus the tolerance (held in 0 to 1), 1 at least."""
    t = min(max(tolerance, 0.0), 1.0)
    return max(1, math.floor(target * (1 - t))), max(1, math.ceil(target * (1 + t)))


def clamp(value: str) -> str:
    return f"greatest(0, least({CELLS - 1}, {value}))"


def bounds_sql(target: str, tolerance: str) -> tuple[str, str]:
    """``bounds`` of columns."""
    within = f"least(1.0D, greatest(0.0D, {tolerance}))"
    return f"greatest(1L, cast(floor({target} * (1 - {within})) as bigint))", f"greatest(1L, cast(ceil({target} * (1 + {within})) as bigint))"
