"""Any number of messages at once: packed, encoded, checked and received without an action for each.

A message is named by its columns ``by`` (where from, where to). Its counts are grouped, its offsets follow from
them, places are numbered within messages over ranges of slots, so that neither many messages nor one of a
large share of all rows need a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import BH, GAS, STAR, PhysicsConfig
from ..schema import record_bytes
from .exchange import BLOCKS, HEADER_BYTES, block_offsets, exchange_counts, exchange_header, validate_header
from .layouts import Layout
from .order import ranked

TYPES = {"gas": GAS, "star": STAR, "bh": BH}
HEADER = [*(f"n_{b}" for b in BLOCKS), "magic", "version", *(f"{b}_bytes" for b in BLOCKS), "total_bytes"]


@dataclass(frozen=True)
class Messages:
    """``headers``: a row a message, with the offsets of its blocks. ``blocks``: rows by block, with place and offset in their message."""

    by: tuple[str, ...]
    headers: DataFrame
    blocks: dict[str, DataFrame]


def domains(leaves: DataFrame, n: int, parts: int) -> DataFrame:
    """Leaves with ``domain``: ``parts`` runs of whole leaves, cut where the rows before pass another share of ``n``."""
    return leaves.withColumn("domain", F.expr(f"cast(begin * {parts} div {max(n, 1)} as int)"))


def pack_messages(layout: Layout, chosen: DataFrame, config: PhysicsConfig, by: tuple[str, ...]) -> Messages:
    """The messages of common rows ``chosen`` (slot, ptype, type_idx, ..., and the columns ``by``).

    A message holds its common rows in the order of their slots without their linkage, and the payload of each type in the order in
    which its rows come. Rows of a type whose physics is off make the job fail when it runs.
    """
    size = record_bytes(config)
    off = [str(t) for b, t in TYPES.items() if not size[b]]
    bare = F.expr("ptype & 127")
    if off:
        chosen = chosen.withColumn("ptype", F.expr(f"if((ptype & 127) in ({', '.join(off)}), raise_error(concat('rows of type ', ptype & 127, ' can''t be sent: their physics is off')), ptype)").cast(chosen.schema["ptype"].dataType))
    headers = block_offsets(exchange_header(exchange_counts(chosen, by), config))
    placed = ranked(chosen, "slot", [], "place", within=list(by))
    at = headers.select(*by, *[f"{b}_offset" for b in BLOCKS])
    blocks = {"common": placed.drop("slot", "type_idx").join(at, list(by)).withColumn("offset", F.col("common_offset") + F.col("place") * size["common"]).drop(*[f"{b}_offset" for b in BLOCKS])}
    typed = ranked(chosen.filter(bare.isin(*TYPES.values())).select(*by, "slot", bare.alias("__t"), "type_idx"), "slot", [], "place", within=[*by, "__t"]).drop("slot").join(at, list(by))
    for b, t in TYPES.items():
        if size[b]:
            own = typed.filter(F.col("__t") == t).withColumn("offset", F.col(f"{b}_offset") + F.col("place") * size[b])
            blocks[b] = own.select(*by, "place", "offset", "type_idx").join(layout.typed[b], "type_idx").drop("type_idx")
    return Messages(by, headers, blocks)


def _fields(schema: T.StructType, left_out: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(f.name, "<f8" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else "<i8") for f in schema if f.name not in left_out]


def message_bytes(messages: Messages, config: PhysicsConfig) -> DataFrame:
    """(*by, offset, bytes): the bytes of all messages; those of one, laid one after the other by offset, are the message."""
    by, size = messages.by, record_bytes(config)
    key = messages.headers.select(*by).schema
    out_schema = T.StructType([*key.fields, T.StructField("offset", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def encoder(fields: list[tuple[str, str]], length: int):
        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                raw = np.zeros((len(f), length), np.uint8)
                for i, (name, kind) in enumerate(fields):
                    raw[:, 8 * i : 8 * i + 8] = f[name].to_numpy().astype(kind).view(np.uint8).reshape(-1, 8)
                yield f[[*by, "offset"]].assign(bytes=[r.tobytes() for r in raw])

        return encode

    words = messages.headers.withColumn("word", F.expr("magic | shiftleft(cast(version as bigint), 32)")).withColumn("offset", F.lit(0).cast("long"))
    words = words.select(*by, "offset", *HEADER[:4], "word", *HEADER[6:])
    out = words.mapInPandas(encoder([(c, "<i8") for c in (*HEADER[:4], "word", *HEADER[6:])], HEADER_BYTES), out_schema)
    for b, rows in messages.blocks.items():
        fields = _fields(rows.schema, (*by, "place", "offset"))
        if 8 * len(fields) > size[b]:
            raise ValueError("the fields exceed the record")
        out = out.unionByName(rows.mapInPandas(encoder(fields, size[b]), out_schema))
    return out


def read_messages(raw: DataFrame, by: tuple[str, ...], like: dict[str, T.StructType], config: PhysicsConfig) -> Messages:
    """Messages from their bytes (*by, offset, bytes); ``like``: the schema of each block's fields.

    A header that isn't one, contradicts itself, or says more bytes than its message has, makes the job that reads it fail, and says which.
    """
    size = record_bytes(config)
    head_schema = T.StructType([*raw.select(*by).schema.fields, *(T.StructField(c, T.LongType()) for c in HEADER)])

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words = np.array([np.frombuffer(bytes(b), "<i8") if len(b) == HEADER_BYTES else np.zeros(10, "<i8") for b in f["bytes"]], "<i8").reshape(-1, 10)
            columns = [*words[:, :4].T, words[:, 4] & 0xFFFFFFFF, words[:, 4] >> 32, *words[:, 5:].T]
            yield f[list(by)].assign(**dict(zip(HEADER, columns, strict=True)))

    found = raw.groupBy(*by).agg(F.sum(F.length("bytes")).cast("long").alias("buffer_bytes"))
    headers = found.join(raw.filter("offset = 0").mapInPandas(heads, head_schema), list(by), "left")
    name = "concat_ws(', ', " + ", ".join(f"cast({c} as string)" for c in by) + ")"
    checked = validate_header(headers, config).withColumn("total_bytes", F.expr(f"if(coalesce(valid, false), total_bytes, raise_error(concat('the header of message ', {name}, ' isn''t valid: ', buffer_bytes, ' bytes')))")).drop("valid", "buffer_bytes")
    headers = block_offsets(checked)
    blocks = {}
    for b, schema in like.items():
        fields = _fields(schema, ())
        own = raw.join(headers.select(*by, F.col(f"{b}_offset").alias("__at"), F.col(f"{b}_bytes").alias("__n"), "total_bytes"), list(by)).filter("total_bytes > 0 and offset >= __at and offset < __at + __n")
        out_schema = T.StructType([*raw.select(*by).schema.fields, T.StructField("place", T.LongType()), T.StructField("offset", T.LongType()), *schema.fields])

        def decode(frames: Iterator[pd.DataFrame], fields=fields, length=size[b], names=out_schema.names) -> Iterator[pd.DataFrame]:
            for f in frames:
                whole = np.frombuffer(b"".join(map(bytes, f["bytes"])), np.uint8).reshape(len(f), length)
                columns = {n: np.ascontiguousarray(whole[:, 8 * i : 8 * i + 8]).view(kind).ravel() for i, (n, kind) in enumerate(fields)}
                yield f[[*by, "offset"]].assign(place=(f["offset"] - f["__at"]) // length, **columns)[names]

        blocks[b] = own.select(*by, "offset", "bytes", "__at").mapInPandas(decode, out_schema)
    return Messages(by, headers, blocks)


def receive(messages: Messages, to: str, held: DataFrame, capacity: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the receivers (column ``to``, one of ``by``) append: common rows with slot and type_idx, payload with type_idx.

    ``held`` (to, n_common, n_gas, n_star, n_bh): what each receiver holds, zeros if it isn't there. The messages of a receiver come
    behind it in the order of the other columns of ``by``; linkage is made anew from the types, and is 0 for rows without payload.
    ``capacity`` has the same columns; a receiver that would exceed it makes the job fail with the figures.
    """
    by = list(messages.by)
    order = Window.partitionBy(to).orderBy(*[c for c in by if c != to]).rowsBetween(Window.unboundedPreceding, -1)
    counts = [f"n_{b}" for b in BLOCKS]
    base = messages.headers.select(*by, *counts).join(held.select(to, *[F.col(c).alias(f"__{c}") for c in counts]), to, "left")
    base = base.select(*by, *[(F.coalesce(F.sum(c).over(order), F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(f"from_{c}") for c in counts], *counts)
    if capacity is not None:
        base = base.join(capacity.select(to, *[F.col(c).alias(f"__{c}") for c in counts]), to, "left")
        for c in counts:
            text = f"concat('receiver ', {to}, ' has room for ', __{c}, ' of {c[2:]}, not for ', from_{c} + {c})"
            base = base.withColumn(f"from_{c}", F.expr(f"if(from_{c} + {c} > __{c}, raise_error({text}), from_{c})"))
    base = base.select(*by, *[f"from_{c}" for c in counts])
    bare = F.expr("ptype & 127")
    common = messages.blocks["common"]
    rows = common.join(base, by).withColumn("slot", F.col("from_n_common") + F.col("place"))
    start = F.expr("case ptype & 127 " + " ".join(f"when {t} then from_n_{b}" for b, t in TYPES.items() if b in messages.blocks) + " end")
    rows = ranked(rows.withColumn("__t", bare), "place", [], "__nth", within=[*by, "__t"])  # of its type within its message
    rows = rows.withColumn("type_idx", F.coalesce(start + F.col("__nth"), F.lit(0)).cast("long"))
    out = {"common": rows.drop("place", "offset", "__t", "__nth", *[f"from_{c}" for c in counts])}
    for b in TYPES:
        if b in messages.blocks:
            own = messages.blocks[b].join(base.select(*by, F.col(f"from_n_{b}").alias("__at")), by)
            out[b] = own.withColumn("type_idx", F.col("__at") + F.col("place")).drop("__at", "place", "offset")
    return out
