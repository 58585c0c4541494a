"""Particle views over stored tables; the SQL reads the same in Spark and elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTICLES = """select o_orderkey as id,
 cast((o_orderkey*1103515245+12345)%2097152 as bigint) as x,
 cast((o_orderkey*69069+o_custkey*7919)%2097152 as bigint) as y,
 cast((o_custkey*1664525+1013904223)%2097152 as bigint) as z,
 cast(case when o_orderkey%10000=0 then 5 when o_orderkey%200=1 then 4 when o_orderkey%2=0 then 0 else 1+o_orderkey%3 end as int) as ptype
 from orders"""
CLUSTERED = """select o_orderkey as id,
 cast((o_custkey%16)*131072+(o_orderkey*o_orderkey*31)%w as bigint) as x,
 cast(((o_custkey*7)%16)*131072+(o_orderkey*69069+o_custkey)%w as bigint) as y,
 cast(((o_custkey*11)%16)*131072+(o_orderkey*7919)%w as bigint) as z,
 cast(case when o_orderkey%10000=0 then 5 when o_orderkey%200=1 then 4 when o_orderkey%2=0 then 0 else 1+o_orderkey%3 end as int) as ptype
 from (select o_orderkey, o_custkey, cast(case o_custkey%4 when 0 then 32 when 1 then 1024 when 2 then 16384 else 131072 end as bigint) as w from orders) as o"""


def particles(spark: SparkSession, sf_dir: str, clustered: bool = False) -> DataFrame:
    """(id, x, y, z, ptype) from ``orders``."""
    return as_particles(spark.read.parquet(f"{sf_dir}/orders.parquet"), clustered)


def as_particles(orders: DataFrame, clustered: bool = False) -> DataFrame:
    """(id, x, y, z, ptype) of rows of ``orders``."""
    text = (CLUSTERED if clustered else PARTICLES).replace("from orders", "from {orders}")
    return orders.sparkSession.sql(text, orders=orders.select("o_orderkey", "o_custkey"))


def write_particles(rows: DataFrame, path: str) -> None:
    """Parquet, one folder per type, sorted by key within a file, so that scans skip by type and key range."""
    rows.sortWithinPartitions("ptype", "key").write.partitionBy("ptype").parquet(path)


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
