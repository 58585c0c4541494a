"""Reading and writing single fields by slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_fields(rows: DataFrame, slots: DataFrame, *fields: str) -> DataFrame:
    """The ``fields`` of the rows in ``slots`` (slot), a row for each that there is."""
    return slots.select("slot").distinct().join(rows.select("slot", *fields), "slot")


def set_fields(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """``rows`` with the fields of ``updates`` (slot, and any of the rows' columns) in the slots that it names; a null is a value, too.

    Slots that the rows lack are passed over. Of several updates of one slot the result is one of them for each row; give one.
    """
    new = [c for c in updates.columns if c != "slot"]
    renamed = updates.select("slot", *[F.col(c).alias(f"__{c}") for c in new], F.lit(True).alias("__set"))
    met = rows.join(renamed, "slot", "left")
    return met.select(*[F.when(F.col("__set"), F.col(f"__{c}").cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])
