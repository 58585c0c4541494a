"""Writing rows and checking them in the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import BH, GAS, STAR
from ..functions.hilbert import CELLS


class Breach(ValueError):
    """What was written is not as it should be; ``figures`` says how much of it."""

    def __init__(self, figures: dict[str, int]) -> None:
        super().__init__(", ".join(f"{k} {v}" for k, v in figures.items()))
        self.figures = figures


def write_checked(rows: DataFrame, leaves: DataFrame, path: str, capacity: dict[str, int] | None = None, max_side: int = CELLS) -> dict[str, int]:
    """Write rows (slot, key, leaf, ptype, ...) to ``path``, and return what was counted on the way.

    Counted by ``observe`` upon the very rows that are written: rows in all and of each type with payload, rows whose slot isn't in the range of
    their leaf (begin to end), on the wrong side of its gas (gas_end, where the leaves have it), whose key isn't in its cube, or whose leaf's cube is wider than
    ``max_side``, and the sum of slots, which with their number tells a gap or a repeated slot. Rows without a leaf are counted, and aren't wrong unless they
    lie before the end of a leaf. ``Breach``, with its figures, if anything is wrong or above ``capacity`` (common, gas, star, bh); the files
    are there then, to be looked at. No second scan is made.
    """
    names = [c for c in ("begin", "end", "gas_end", "key_begin", "key_last", "side_cells") if c in leaves.columns]
    met = rows.join(leaves.select("leaf", *[F.col(c).alias(f"__{c}") for c in names]), "leaf", "left")
    edge = leaves.agg(F.max("end")).first()[0] or 0
    tests = {"range": f"if(leaf is null, slot < {edge}, __begin is null or slot < __begin or slot >= __end)"}
    if "key_begin" in names:
        tests["cube"] = "leaf is not null and not coalesce(key between __key_begin and __key_last, false)"
    if "gas_end" in names:
        tests["gas"] = "leaf is not null and (ptype = 0) <> (slot < __gas_end)"
    if "side_cells" in names:
        tests["side"] = f"__side_cells > {max(max_side, 1)}"
    seen = Observation()
    counted = [F.count(F.lit(1)).alias("common"), *[F.count_if((F.col("ptype").bitwiseAND(F.lit(127))) == t).alias(k) for k, t in (("gas", GAS), ("star", STAR), ("bh", BH))]]
    wrong = [F.count_if(F.expr(test)).alias(f"wrong_{k}") for k, test in tests.items()]
    slots = [F.coalesce(F.sum(F.col("slot").cast("decimal(38,0)")), F.lit(0)).alias("slots"), F.coalesce(F.max("slot"), F.lit(-1)).alias("last"), F.coalesce(F.min("slot"), F.lit(0)).alias("first"), F.count_if(F.col("leaf").isNull()).alias("outside")]
    met.observe(seen, *counted, *wrong, *slots).select(*rows.columns).write.mode("overwrite").parquet(path)
    got = {k: int(v) for k, v in seen.get.items()}
    n = got["common"]
    breach = {k: v for k, v in got.items() if k.startswith("wrong_") and v}
    if got["first"] != 0 or got["last"] != n - 1 or 2 * got["slots"] != n * (n - 1):
        breach |= {"rows": n, "first_slot": got["first"], "last_slot": got["last"]}
    breach |= {f"{k}_over": got[k] - most for k, most in (capacity or {}).items() if got[k] > most}
    if breach:
        raise Breach(breach)
    return {k: v for k, v in got.items() if k not in ("slots", "first", "last")}
