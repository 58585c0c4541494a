"""Incremental archive of typed records: new files of documents go behind what the archive holds.

    python -m jobs.archive_documents DOCUMENTS OUTPUT CHECKPOINT [--config FILE]

Like a store of particles, the archive keeps records of several types, here documents by language, each type in a block of its
own: a record has its place among its type (``type_idx``) and the byte at which it begins in the type's block (``first_byte``),
both going on from batch to batch without gaps. A file stream with a checkpoint takes only files that it hasn't
taken before, and ends when there are no more.

Written are ``records``, partitioned by batch and kind, and ``counts``, what each batch added to each kind: the
high-water marks. A batch that is run again, since the run before was lost on its way, overwrites its own partitions with the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilbertine.operators.order import ranked, running_sum

log = logging.getLogger(__name__)
CONFIG = Path(__file__).with_suffix(".json")
RECORDS = "doc_id long, source string, text string, n_bytes long, text_md5 string, type_idx long, first_byte long, batch long, kind string"
#: Records, with their texts, that one task orders or sums up.
RANGE_ROWS = 10_000
COUNTS = "kind string, n long, n_bytes long, batch long"


def defaults() -> dict:
    return json.loads(CONFIG.read_text())


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take the files at ``documents`` that are new to ``checkpoint`` into the archive at ``output``; returns all of its records, read back.

    A type that is null or empty is ``none``; a null text has no bytes. Within a batch, records of a kind come
    by doc_id (nulls first), then MD5 of the text, then source; rows alike in all of these may change places.
    """
    c = defaults() | (config or {})
    _begun(spark, f"{output}/records", RECORDS, "batch", "kind")
    _begun(spark, f"{output}/counts", COUNTS, "batch")
    stream = spark.readStream.schema(spark.read.parquet(documents).schema)
    if int(c["files_per_batch"]):
        stream = stream.option("maxFilesPerTrigger", int(c["files_per_batch"]))
    rows = stream.parquet(_pattern(documents)).select("doc_id", "source", "text", F.col(c["type_column"]).alias("kind"))
    query = rows.writeStream.foreachBatch(lambda batch, number: _append(batch, number, output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total = spark.read.schema(COUNTS).parquet(f"{output}/counts").agg(F.count_distinct("batch"), F.sum("n"), F.sum("n_bytes")).first()
    log.info("%s holds %d batches, %d records, %d bytes", output, total[0], total[1] or 0, total[2] or 0)
    return spark.read.schema(RECORDS).parquet(f"{output}/records")


def _pattern(path: str) -> str:
    """A pattern that only ``path`` matches: a file stream takes a plain path of a folder alone, but patterns of files, too."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _begun(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """The folder exists afterwards; what it holds stays."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)


def _append(batch: DataFrame, number: int, output: str) -> None:
    spark = batch.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = batch.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"),
        F.coalesce(F.expr("nullif(cast(kind as string), '')"), F.lit("none")).alias("kind"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("__by"),
    ).persist()
    held = spark.read.schema(COUNTS).parquet(f"{output}/counts").filter(F.col("batch") < number).groupBy("kind").agg(F.sum("n").alias("__n"), F.sum("n_bytes").alias("__bytes"))
    nth = ranked(rows, "__by", ["text_md5", F.asc_nulls_first("source")], "__nth", within="kind", rows_per_range=RANGE_ROWS)
    placed = running_sum(nth, "__nth", "n_bytes", "__earlier", block=RANGE_ROWS, within=("kind",)).join(held, "kind", "left").withColumn("batch", F.lit(number).cast("long"))
    placed = placed.withColumn("type_idx", F.col("__nth") + F.coalesce("__n", F.lit(0))).withColumn("first_byte", F.col("__earlier") + F.coalesce("__bytes", F.lit(0)))
    _write(placed.select(*[f.split(" ")[0] for f in RECORDS.split(", ")]), f"{output}/records", "batch", "kind")
    added = spark.read.schema(RECORDS).parquet(f"{output}/records").filter(F.col("batch") == number)  # what is there, not what was meant
    _write(added.groupBy("kind", "batch").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes")).select("kind", "n", "n_bytes", "batch"), f"{output}/counts", "batch")
    marks = spark.read.schema(COUNTS).parquet(f"{output}/counts").filter(F.col("batch") == number).agg(F.count("*"), F.sum("n"), F.sum("n_bytes")).first()
    log.info("batch %d: read %d documents, wrote %d records of %d kinds, %d bytes", number, rows.count(), marks[1] or 0, marks[0], marks[2] or 0)
    rows.unpersist()


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config", default=str(CONFIG))
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("archive_documents").getOrCreate()
    try:
        run(spark, a.documents, a.output, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
