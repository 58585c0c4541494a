"""Exchange of domains: particles move to the part whose leaves they lie in, in tight messages from part to part.

    python -m jobs.exchange_domains ORDERS OUTPUT [--config FILE]

Rows are held by ``parts`` parts in the order of their ids. The job keys and orders them, tiles them into leaves, cuts
the leaves into as many runs of about equal weight, and packs what has to move: one message for each pair of parts, with a header,
blocks by type, and each record's place and offset. Written are ``headers`` and ``records``, partitioned by receiver
(``dest``), as Parquet. A run replaces the result of the run before, so that it may be repeated at any time.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilbertine.config import PRESETS
from hilbertine.operators import layouts
from hilbertine.operators.leaves import build_leaves, find_leaf
from hilbertine.operators.messages import domains, pack_messages
from hilbertine.plans.maintenance import slotted
from hilbertine.sources.shared import clear_written, written
from hilbertine.sources.views import as_particles

log = logging.getLogger(__name__)
CONFIG = Path(__file__).with_suffix(".json")
BY = ("source", "dest")


def defaults() -> dict:
    return json.loads(CONFIG.read_text())


def run(spark: SparkSession, orders: str, output: str, config: dict | None = None) -> DataFrame:
    """Write the messages of the particles in the table at ``orders``, and return the records with their message's counts, read back."""
    c = defaults() | (config or {})
    parts, physics = int(c["parts"]), PRESETS[c["preset"]]
    if parts < 1:
        raise ValueError("parts must be 1 at least")
    rows = slotted(as_particles(spark.read.parquet(orders)))
    n = rows.count()
    log.info("read %d particles from %s", n, orders)
    leaves = written(domains(build_leaves(rows, int(c["target"]), float(c["tolerance"])), n, parts))
    laid = layouts.fill("Bc", rows)
    homes = find_leaf(laid.common, leaves, n=n).join(leaves.select("leaf", F.col("domain").alias("dest")), "leaf").drop("leaf")
    moving = written(homes.withColumn("source", F.expr(f"cast(id * {parts} div {max(n, 1)} as int)")).filter("source <> dest"))
    messages = pack_messages(laid, moving, physics, BY)
    _write(messages.headers, f"{output}/headers", "dest", "source")
    records = None
    for block, part in messages.blocks.items():
        part = part.withColumnRenamed("owner", "id").withColumn("block", F.lit(block))
        records = part if records is None else records.unionByName(part, allowMissingColumns=True)
    piece = F.expr(f"place div {int(c['rows_per_file'])}")  # a large message is written by several tasks
    _write(records.repartition("dest", "source", "block", piece), f"{output}/records", "source", "offset")
    back, heads = spark.read.parquet(f"{output}/records"), spark.read.parquet(f"{output}/headers")
    sent = heads.agg(F.count("*"), F.sum("n_common"), F.sum("total_bytes")).first()
    log.info("wrote %d messages of %s particles and %s bytes to %s", sent[0], sent[1] or 0, sent[2] or 0, output)
    return back.join(heads.select(*BY, "n_common", "total_bytes"), list(BY))


def _write(df: DataFrame, path: str, *order: str) -> None:
    df.sortWithinPartitions("dest", *[o for o in order if o != "dest"]).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dest").parquet(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("orders")
    parser.add_argument("output")
    parser.add_argument("--config", default=str(CONFIG))
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("exchange_domains").getOrCreate()
    try:
        run(spark, a.orders, a.output, json.loads(Path(a.config).read_text()))
    finally:
        clear_written(spark)
        spark.stop()


if __name__ == "__main__":
    main()
