"""Type sets and bit flags, as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STAGED

# Bits of a row's and of a leaf's flags.
PARTICLE_FLAGS = {"Active": 1, "Boundary": 2, "NeedsWakeup": 4, "ToBeDeleted": 8, "NewlyCreated": 16, "PendingMutation": 32}
LEAF_FLAGS = {"Active": 1, "NeedsUpdate": 2, "Boundary": 4, "HasGas": 8, "HasStar": 16, "HasBH": 32, "HasDM": 64, "HasStaged": 128}


def is_gas(t: str = "ptype") -> str:
    return f"({t} = 0)"


def is_dm(t: str = "ptype") -> str:
    return f"({t} in (1, 2, 3))"


def is_star(t: str = "ptype") -> str:
    return f"({t} = 4)"


def is_bh(t: str = "ptype") -> str:
    return f"({t} = 5)"


def is_baryon(t: str = "ptype") -> str:
    """Gas and stars; a black hole is none."""
    return f"({t} in (0, 4))"


def mark_staged(t: str) -> str:
    return f"(({t}) | {STAGED})"


def is_staged(t: str) -> str:
    return f"((({t}) & {STAGED}) <> 0)"


def bare_type(t: str) -> str:
    return f"(({t}) & {STAGED - 1})"


def set_flag(flags: str, bit: int) -> str:
    return f"(({flags}) | {bit})"


def clear_flag(flags: str, bit: int) -> str:
    return f"(({flags}) - (({flags}) & {bit}))"


def has_flag(flags: str, bit: int) -> str:
    return f"((({flags}) & {bit}) <> 0)"


def optional(df: DataFrame, name: str, fallback) -> Column:
    """A column, or ``fallback`` where the table doesn't have it."""
    return F.col(name) if name in df.columns else F.lit(fallback)


def apply_if_present(df: DataFrame, name: str, change) -> DataFrame:
    """``df`` with ``change(column)`` for a column that it has; otherwise as it is."""
    return df.withColumn(name, change(F.col(name))) if name in df.columns else df
