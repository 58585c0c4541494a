"""Debug marks: 64-bit mixing of an id and a tag, inside generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the mixing.
SEED, FACTOR = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
LOW = 0xFFFFFFFF


def _signed(x: int) -> str:
    x %= 1 << 64
    return f"{x}L" if x < 1 << 63 else f"({x - (1 << 64) + 1}L - 1L)"


def _times(df: DataFrame, name: str, factor: int) -> DataFrame:
    """``df`` with the bigint ``name`` multiplied modulo 2^64, by halves that can't overflow."""
    low, high = factor & LOW, factor >> 32
    part = lambda half, f: f"(({half} * {f & 0xFFFF}L + (({half} * {f >> 16}L) & 65535L) * 65536L) & {LOW}L)"  # noqa: E731  half * f modulo 2^32
    return (
        df.selectExpr("*", f"{name} & {LOW}L as __a0", f"shiftrightunsigned({name}, 32) as __a1")
        .selectExpr("*", f"__a0 * {low & 0xFFFF}L as __t0", f"shiftleft(__a0 * {low >> 16}L, 16) as __t1", f"{part('__a1', low)} + {part('__a0', high)} as __t2")
        .selectExpr("*", f"(__t0 & {LOW}L) + (__t1 & {LOW}L) as __s")
        .withColumn(name, F.expr(f"shiftleft(shiftrightunsigned(__t0, 32) + shiftrightunsigned(__t1, 32) + shiftrightunsigned(__s, 32) + __t2, 32) | (__s & {LOW}L)"))
        .drop("__a0", "__a1", "__t0", "__t1", "__t2", "__s")
    )


def with_marks(df: DataFrame, tag: int, id_col: str = "id", mark: str = "mark", short: str = "short") -> DataFrame:
    """``df`` with ``mark``, the 64-bit mark of an id and a tag as unsigned decimal text, and ``short``, its 32-bit form."""
    first = f"{id_col} ^ {_signed(SEED + (tag << 32))}"
    out = df.withColumn("__m", F.expr(first)).withColumn("__m", F.expr("__m ^ shiftrightunsigned(__m, 33)"))
    out = _times(out, "__m", FACTOR).withColumn("__m", F.expr("__m ^ shiftrightunsigned(__m, 33)"))
    return out.withColumn(mark, F.expr("conv(hex(__m), 16, 10)")).withColumn(short, F.expr(f"(__m ^ shiftrightunsigned(__m, 32)) & {LOW}L")).drop("__m")
