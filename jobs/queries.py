"""The jobs as queries over whole tables: each runs twice into one new folder, and returns what is there afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hilbertine.queries import tiled
from hilbertine.shipping import shipped
from hilbertine.sources.shared import new_folder

from . import archive_documents, exchange_domains


@shipped
def job1_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one batch; the second run finds nothing new."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        out = archive_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/archive", f"{folder}/checkpoint")
    return out


@shipped
def job2_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all particles that change their part; the second run writes them again."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        out = exchange_domains.run(spark, f"{sf_dir}/orders.parquet", folder)
    return out


_ARCHIVE = """
with d as (select doc_id, source, text, cast(coalesce(strlen(text), 0) as bigint) as n_bytes, md5(coalesce(text, '')) as text_md5, coalesce(nullif(lang, ''), 'none') as kind from documents)
select *, row_number() over w - 1 as type_idx, cast(coalesce(sum(n_bytes) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as first_byte, cast(0 as bigint) as batch
from d window w as (partition by kind order by doc_id nulls first, text_md5, source nulls first)
"""

_FIELDS = {"gas": {"density": "slot * 1e-4", "metals0": "slot % 1000"}, "star": {"stellar_age": "slot * 1e-5"}, "bh": {"bh_mass": "slot * 1e-6"}}


def _domains(parts: int) -> str:
    payload = [c for f in _FIELDS.values() for c in f]
    common = "key, x, y, z, ptype, vel_x, ti_current, " + ", ".join(f"cast(null as double) as {c}" for c in payload)
    blocks, at, size = [f"select source, dest, place, 80 + 192 * place as \"offset\", id, {common}, 'common' as block from place_"], "80 + 192 * n_common", {"gas": 256, "star": 128, "bh": 320}
    for block, t in (("gas", 0), ("star", 4), ("bh", 5)):
        own = ", ".join(f"cast({_FIELDS[block][c]} as double) as {c}" if c in _FIELDS[block] else f"cast(null as double) as {c}" for c in payload)
        empty = "cast(null as bigint) as key, cast(null as bigint) as x, cast(null as bigint) as y, cast(null as bigint) as z, cast(null as integer) as ptype, cast(null as double) as vel_x, cast(null as bigint) as ti_current"
        blocks.append(f"select source, dest, nth as place, {at} + {size[block]} * nth as \"offset\", id, {empty}, {own}, '{block}' as block from (select * replace (cast(slot as double) as slot) from place_ join head_ using (source, dest) where ptype = {t})")
        at += f" + {size[block]} * n_{block}"
    return f"""
{tiled()}, n_ as (select count(*) as n from rows_),
send_ as (select r.*, cast(id * {parts} // n as integer) as source, cast(l."begin" * {parts} // n as integer) as dest, cast(slot as double) * 1e-3 as vel_x, slot as ti_current from rows_ r join leaf_ l on r.slot >= l."begin" and r.slot < l."end", n_),
place_ as (select *, row_number() over (partition by source, dest order by slot) - 1 as place, row_number() over (partition by source, dest, ptype order by slot) - 1 as nth from send_ where source <> dest),
head_ as (select source, dest, count(*) as n_common, count(*) filter (ptype = 0) as n_gas, count(*) filter (ptype = 4) as n_star, count(*) filter (ptype = 5) as n_bh from place_ group by 1, 2)
select r.*, n_common, {at} as total_bytes from ({' union all '.join(blocks)}) r join head_ using (source, dest)
"""


def queries() -> dict:
    return {"job1_archive": job1_archive, "job2_domains": job2_domains}


def oracle_sql() -> dict[str, str]:
    return {"job1_archive": _ARCHIVE, "job2_domains": _domains(exchange_domains.defaults()["parts"])}
