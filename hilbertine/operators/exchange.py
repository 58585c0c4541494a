"""Sending typed rows: tight blocks, headers, unpacking behind what is there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BH, GAS, STAR, PhysicsConfig
from ..schema import record_bytes
from ..sources.shared import written
from .layouts import PAYLOADS, Layout
from .order import ranked

# Fixed values of the header.
HEADER_BYTES, MAGIC, VERSION = 80, 0x4F504742, 2
BLOCKS = ("common", "gas", "star", "bh")


def select_range(common: DataFrame, start: int, count: int) -> DataFrame:
    """Rows of slots start to start + count with ``seq``, their place in the message."""
    return common.filter((F.col("slot") >= start) & (F.col("slot") < start + count)).withColumn("seq", F.col("slot") - start)


def select_list(common: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows of a list of slots (seq, slot), in its order; a slot may come more than once."""
    return common.join(indices.select("seq", "slot"), "slot")


def exchange_counts(chosen: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each block that a selection sends, in all or for each message named by the columns ``by``."""
    bare = F.expr("ptype & 127")
    return chosen.groupBy(*by).agg(F.count("*").alias("n_common"), *[F.count_if(bare == t).alias(f"n_{k}") for k, t in (("gas", GAS), ("star", STAR), ("bh", BH))])


def exchange_header(counts: DataFrame, config: PhysicsConfig) -> DataFrame:
    """Header of a message with these counts: magic, version, bytes of each block and in all."""
    size = record_bytes(config)
    out = counts.withColumn("magic", F.lit(MAGIC).cast("long")).withColumn("version", F.lit(VERSION))
    for b in BLOCKS:
        out = out.withColumn(f"{b}_bytes", F.col(f"n_{b}") * F.lit(size[b]).cast("long"))
    return out.withColumn("total_bytes", F.expr(f"{HEADER_BYTES}L + " + " + ".join(f"{b}_bytes" for b in BLOCKS)))


def validate_header(headers: DataFrame, config: PhysicsConfig, buffer: str = "buffer_bytes") -> DataFrame:
    """``headers`` with ``valid``: known magic and version, blocks and total as the counts say, buffer large enough."""
    size = record_bytes(config)
    blocks = " and ".join(f"{b}_bytes = n_{b} * {size[b]}" for b in BLOCKS)
    total = f"total_bytes = {HEADER_BYTES} + " + " + ".join(f"{b}_bytes" for b in BLOCKS)
    return headers.withColumn("valid", F.expr(f"magic = {MAGIC} and version = {VERSION} and {blocks} and {total} and {buffer} >= total_bytes"))


def block_offsets(headers: DataFrame) -> DataFrame:
    """Where each block begins in the message."""
    out, at = headers, f"{HEADER_BYTES}L"
    for b in BLOCKS:
        out = out.withColumn(f"{b}_offset", F.expr(at))
        at = f"{at} + {b}_bytes"
    return out


def pack(layout: Layout, chosen: DataFrame, config: PhysicsConfig) -> dict[str, DataFrame]:
    """The blocks of a message: common rows by ``seq`` without their linkage, payload rows in the order in which they come.

    Refuses rows of a type whose physics is off. The chosen rows are written to the shared folder, for each block numbers
    them by itself and would find them anew several times.
    """
    size = record_bytes(config)
    chosen = written(chosen)
    bare = F.expr("ptype & 127")
    for name, (t, _) in PAYLOADS.items():
        if not size[name] and chosen.filter(bare == t).limit(1).count():
            raise ValueError(f"rows of type {t} can't be sent: their physics is off")
    out = {"common": chosen.drop("type_idx", "slot")}
    for name, (t, _) in PAYLOADS.items():
        if size[name]:
            rows = ranked(chosen.filter(bare == t).select("seq", "type_idx"), "seq", [], "block_seq")
            out[name] = rows.drop("seq").join(layout.typed[name], "type_idx").drop("type_idx")
    return out


def _record(schema: T.StructType, left_out: tuple[str, ...]) -> list[tuple[str, str]]:
    """(column, NumPy type) of a record's fields, eight bytes each, in the order of the columns."""
    return [(f.name, "<f8" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else "<i8") for f in schema if f.name not in left_out]


_PLACE = {"common": "seq", "gas": "block_seq", "star": "block_seq", "bh": "block_seq"}


def to_buffer(message: dict[str, DataFrame], config: PhysicsConfig) -> DataFrame:
    """The bytes of a message as rows (offset, bytes): the header, then a record of its block's size for each row.

    Laid one after the other by offset, the rows are the message; blocks are packed tightly.
    """
    size, spark = record_bytes(config), message["common"].sparkSession
    n = {b: message[b].count() if b in message else 0 for b in BLOCKS}
    sizes = [n[b] * size[b] for b in BLOCKS]
    words = [*n.values(), MAGIC | VERSION << 32, *sizes, HEADER_BYTES + sum(sizes)]
    out = spark.createDataFrame([(0, bytearray(np.asarray(words, "<i8").tobytes()))], "offset long, bytes binary")
    at = HEADER_BYTES
    for b, of_block in zip(BLOCKS, sizes, strict=True):
        if n[b]:
            out = out.unionByName(_encoded(message[b], _PLACE[b], size[b], at))
        at += of_block
    return out


def _encoded(rows: DataFrame, place: str, size: int, at: int) -> DataFrame:
    record = _record(rows.schema, (place,))
    if 8 * len(record) > size:
        raise ValueError("the fields exceed the record")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = np.zeros((len(f), size), np.uint8)
            for i, (name, kind) in enumerate(record):
                raw[:, 8 * i : 8 * i + 8] = f[name].to_numpy().astype(kind).view(np.uint8).reshape(-1, 8)
            yield pd.DataFrame({"offset": at + size * f[place].to_numpy(), "bytes": [r.tobytes() for r in raw]})

    return rows.mapInPandas(encode, "offset long, bytes binary")


def read_header(buffer: DataFrame) -> DataFrame:
    """The header of a message's bytes, and ``buffer_bytes``, how many there are."""
    raw = buffer.filter("offset = 0").first()
    if raw is None or len(raw["bytes"]) != HEADER_BYTES:
        raise ValueError("no header")
    words = [int(w) for w in np.frombuffer(bytes(raw["bytes"]), "<i8")]
    names = [*(f"n_{b}" for b in BLOCKS), "magic", "version", *(f"{b}_bytes" for b in BLOCKS), "total_bytes"]
    found = buffer.agg(F.sum(F.length("bytes"))).first()[0]
    row = (*words[:4], words[4] & 0xFFFFFFFF, words[4] >> 32, *words[5:], found)
    return buffer.sparkSession.createDataFrame([row], ", ".join(f"{c} long" for c in [*names, "buffer_bytes"]))


def from_buffer(buffer: DataFrame, like: dict[str, T.StructType], config: PhysicsConfig) -> dict[str, DataFrame]:
    """The blocks of a message from its bytes; ``like``: the schema of each block.

    ValueError if the header is not one, contradicts itself, or says more bytes than there are.
    """
    header = block_offsets(validate_header(read_header(buffer), config)).first()
    if not header["valid"]:
        raise ValueError("the header isn't valid")
    size, out = record_bytes(config), {}
    for b in BLOCKS:
        if b in like:
            at = header[f"{b}_offset"]
            part = buffer.filter((F.col("offset") >= at) & (F.col("offset") < at + header[f"{b}_bytes"]))
            out[b] = _decoded(part, like[b], _PLACE[b], size[b], at)
    return out


def _decoded(rows: DataFrame, schema: T.StructType, place: str, size: int, at: int) -> DataFrame:
    record = _record(schema, (place,))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = np.frombuffer(b"".join(map(bytes, f["bytes"])), np.uint8).reshape(len(f), size)
            columns = {name: np.ascontiguousarray(raw[:, 8 * i : 8 * i + 8]).view(kind).ravel() for i, (name, kind) in enumerate(record)}
            columns[place] = (f["offset"].to_numpy() - at) // size
            yield pd.DataFrame({c: columns[c] for c in schema.names})

    return rows.mapInPandas(decode, schema)


def unpack(layout: Layout, message: dict[str, DataFrame], at: int, n: dict[str, int], capacity: dict[str, int] | None = None) -> Layout:
    """Put a message's rows behind slot ``at`` of a layout and its payload behind what each table holds (``n``).

    Indices are made anew from the types; a row without payload gets 0. Rows from slot ``at``
    on are overwritten, as the table ends with the message. Everything is checked before anything changes.
    """
    count = message["common"].count()
    if capacity:
        sizes = {k: message[k].count() for k in PAYLOADS if k in message}
        if at + count > capacity["common"] or any(n[k] + sizes[k] > capacity[k] for k in sizes):
            raise ValueError("the message exceeds the capacity")
    common = message["common"].withColumn("slot", F.col("seq") + at)
    bare = F.expr("ptype & 127")
    parts, typed = [], dict(layout.typed)
    for name, (t, _) in PAYLOADS.items():
        rows = common.filter(bare == t)
        if name not in message:
            continue
        parts.append(ranked(rows, "seq", [], "__r").withColumn("type_idx", F.col("__r") + n[name]).drop("__r"))
        new = message[name].withColumn("type_idx", F.col("block_seq") + n[name]).drop("block_seq")
        typed[name] = layout.typed[name].filter(F.col("type_idx") < n[name]).unionByName(new)
    rest = common.filter(~bare.isin([t for name, (t, _) in PAYLOADS.items() if name in message])).withColumn("type_idx", F.lit(0).cast("long"))
    new_common = rest
    for p in parts:
        new_common = new_common.unionByName(p)
    return Layout(layout.kind, layout.common.filter(F.col("slot") < at).unionByName(new_common.select(*layout.common.columns)), typed)


def exchange_sizes(config: PhysicsConfig, n: dict[str, int]) -> dict[str, float]:
    """Bytes of a tight message, of one of fixed records, and what the former saves in per cent."""
    size = record_bytes(config)
    tight = HEADER_BYTES + sum(n[b] * size[b] for b in BLOCKS)
    fixed = n["common"] * size["legacy_fixed"]
    if n["gas"] + n["star"] + n["bh"] > n["common"]:
        raise ValueError("more typed rows than rows")
    return {"tight_bytes": tight, "fixed_bytes": fixed, "saving_pct": 100.0 * (1 - tight / fixed) if fixed else 0.0}


def with_exchange_sizes(counts: DataFrame, config: PhysicsConfig) -> DataFrame:
    """``counts`` (n_common, n_gas, n_star, n_bh, ...) with tight_bytes, fixed_bytes and saving_pct of a message of each row's counts."""
    out = exchange_header(counts, config).withColumn("tight_bytes", F.col("total_bytes"))
    out = out.withColumn("fixed_bytes", (F.col("n_common") * record_bytes(config)["legacy_fixed"]).cast("long"))
    saved = F.when(F.col("fixed_bytes") > 0, 100.0 * (1 - F.col("tight_bytes").cast("double") / F.col("fixed_bytes"))).otherwise(0.0)
    return out.withColumn("saving_pct", saved).drop("magic", "version", "total_bytes", *[f"{b}_bytes" for b in BLOCKS])
