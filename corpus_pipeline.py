"""A training-corpus pipeline: each stage reads what its predecessor has written.

Each function takes (spark, docs, sf_dir) and returns a DataFrame with the
columns of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilbertine.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from hilbertine.llm.queries import tokenizer_path
from hilbertine.llm.scratch import materialise
from hilbertine.shipping import shipped

#: SQL cannot express the trained model or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more go. The model learns from the rows that op3's contract allows.

    A null or blank text is scored like any other, by the share of toxic ones; without labels nothing goes.
    """
    allowed = toxicity.remainder(F.col("doc_id"), 4) != 2
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), allowed)
    return toxicity.keep_ordinary(docs, model)


@shipped
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one occurrence stays. Documents stay, if with less text, but for those left without any.

    Documents whose text was null or blank before stay.
    """
    return line_dedup.dedup_lines(docs, drop_emptied=True).select(*docs.columns)


@shipped
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more stays.

    Null and blank texts are linked with nothing and stay.
    """
    return ngram_join.keep_one_of_each(docs, 5, 0.8)


@shipped
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go; an empty benchmark drops nothing."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null text is its separator alone."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
