"""Exact storage and movement costs of the layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PhysicsConfig
from ..schema import BENCH_COARSE_COMMON, BENCH_COMMON, BENCH_LINKAGE, BENCH_SLOT, BENCH_TYPED, BENCH_WHOLE, common_atoms, size_of, typed_atoms

LAYOUTS = ("A", "B", "Bc", "C")
#: A dense gather reads and writes everything twice; a swap reads and writes two structs three times.
DENSE_PASSES, SWAP_PASSES = 4, 6
_COMMON = sum(BENCH_COMMON.values())
_TYPED = {k: sum(v.values()) for k, v in BENCH_TYPED.items()}


def reorder_bytes(layout: str, n: dict[str, int]) -> int:
    """Bytes that a dense reorder moves, by rows of each kind (gas, dm, star, bh)."""
    total = sum(n.values())
    if layout == "A":
        return DENSE_PASSES * sum(n[k] * BENCH_WHOLE[k] for k in n) + total * BENCH_SLOT
    if layout == "B":
        return DENSE_PASSES * total * (_COMMON + BENCH_LINKAGE)
    if layout == "Bc":
        return DENSE_PASSES * total * BENCH_COARSE_COMMON
    return DENSE_PASSES * (total * _COMMON + sum(n[k] * _TYPED[k] for k in _TYPED)) + total * 8


def reorder_streams(layout: str, n: dict[str, int]) -> int:
    """Arrays that a reorder moves."""
    if layout == "A":
        return sum(v > 0 for v in n.values())
    if layout in ("B", "Bc"):
        return {"B": 5, "Bc": 4}[layout]
    return len(BENCH_COMMON) + sum(len(BENCH_TYPED[k]) for k in BENCH_TYPED if n[k])


def reorder_streams_of(layout: str, n: dict[str, Column]) -> Column:
    """``reorder_streams`` of columns that hold the rows of each kind."""
    there = {k: F.when(v > 0, 1).otherwise(0) for k, v in n.items()}
    if layout == "A":
        return sum(there.values(), F.lit(0))
    if layout in ("B", "Bc"):
        return F.lit({"B": 5, "Bc": 4}[layout])
    return sum((there[k] * len(v) for k, v in BENCH_TYPED.items()), F.lit(len(BENCH_COMMON)))


def stored_bytes(layout: str, n: dict[str, Column]) -> Column:
    """Bytes that rows take in the benchmark's structs, by columns that hold the rows of each kind."""
    total = sum(n.values(), F.lit(0))
    if layout == "A":
        return sum((n[k] * BENCH_WHOLE[k] for k in n), total * BENCH_SLOT)
    common = {"B": _COMMON + BENCH_LINKAGE, "Bc": BENCH_COARSE_COMMON, "C": _COMMON}[layout]
    return sum((n[k] * v for k, v in _TYPED.items()), total * common)


def swap_bytes(layout: str, kind: str) -> int:
    """Bytes that exchanging two rows of a kind moves."""
    per = {"A": BENCH_WHOLE[kind], "B": _COMMON + BENCH_LINKAGE, "Bc": BENCH_COARSE_COMMON, "C": _COMMON + _TYPED.get(kind, 0)}
    return SWAP_PASSES * per[layout]


def swap_streams(layout: str, kind: str) -> int:
    return {"A": 1, "B": 5, "Bc": 4, "C": len(BENCH_COMMON) + len(BENCH_TYPED.get(kind, ()))}[layout]


def sparse_bytes(dense: int, changed: int, n: int) -> int:
    """Estimate for a sparse reorder that changes some of n slots."""
    return dense * changed // (2 * n) if n else 0


def allocated_bytes(config: PhysicsConfig, layout: str, capacity: dict[str, int], align: int = 64) -> int:
    """Bytes that a container of this capacity (common, gas, star, bh) takes."""
    common = sum(size_of(a, config, 8 if a == "linkage" else align) for a in common_atoms(config, layout))
    typed = {k: sum(size_of(a, config, 32) for a in v) for k, v in typed_atoms(config).items()}
    if layout == "Bc":
        typed = {k: -(-v // 64) * 64 for k, v in typed.items()}
    return capacity["common"] * common + sum(capacity[k] * v for k, v in typed.items())


def size_report() -> list[tuple[str, str, int]]:
    """(layout, struct, bytes) of the benchmark."""
    out = [("A", k, v) for k, v in BENCH_WHOLE.items()] + [("A", "slot", BENCH_SLOT)]
    fine = [*BENCH_COMMON.items(), *(x for v in BENCH_TYPED.values() for x in v.items())]
    out += [("B", k, v) for k, v in [*fine, ("PLinkage", BENCH_LINKAGE)]] + [("C", k, v) for k, v in fine]
    return out + [("Bc", "common", BENCH_COARSE_COMMON), *[("Bc", k, v) for k, v in _TYPED.items()]]
