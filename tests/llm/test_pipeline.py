import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from hilbertine.llm import ngram_join, packing, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs, edges, none  # noqa: E402
from test_decontamination import brute as contaminated  # noqa: E402
from test_line_dedup import brute as repeated_lines  # noqa: E402
from test_ngram_join import brute as components  # noqa: E402
from test_toxicity import corpus  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    texts, toxic = corpus(500, 4)
    shared = " ".join(f"licence{i}" for i in range(60))
    item = " ".join(f"question{i}" for i in range(15))
    for i in range(0, 120, 4):
        if not toxic[i]:
            texts[i] += "\n" + shared
    for i in range(1, 60, 6):
        if not toxic[i]:
            texts[i] += " " + item
    clean = [i for i in range(200, 260) if not toxic[i] and len(texts[i].split()) > 30]
    for a, b in zip(clean[:10:2], clean[1:10:2]):
        texts[b] = texts[a] + " end"
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "short item here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = {i: t for i, t in enumerate(texts)}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(d, spark.read.parquet(f"{tmp_path}/labels.parquet"), toxicity.remainder(F.col("doc_id"), 4) != 2)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(d, model).collect()}
    rows = {i: t for i, t in rows.items() if scores[i] < 0.3}
    assert sum(i in rows for i in range(500) if not toxic[i]) / toxic.count(0) > 0.97
    keys = sorted(rows)
    drop, _ = repeated_lines([rows[i] for i in keys], 5, 0.8)
    left = ["\n".join(x for n, x in enumerate(rows[i].split("\n")) if (p, n) not in drop) for p, i in enumerate(keys)]
    rows = {i: t for i, t in zip(keys, left, strict=True) if t == rows[i] or t.strip()}
    keys = sorted(rows)
    assert sum(shared in t for t in rows.values()) == 1
    groups = components([rows[i] for i in keys], 5, 80)
    rows = {i: rows[i] for p, i in enumerate(keys) if groups[p][1] == p}
    items = [(1, item), (2, "short item here")]
    rows = {i: t for i, t in rows.items() if not contaminated(t, items, 10)[-1]}
    want = {i: len(b) // 4 + 1 for i, b in zip(rows, packing.encode_texts(list(rows.values()), corpus_pipeline.tokenizer_path()), strict=True)}

    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want
    assert len(corpus_pipeline.STAGES) == 5 and ngram_join.keep_one_of_each(d.limit(0)).count() == 0


LABELS, ITEMS = "doc_id long, toxic int", "item_id long, text string"


def tables(spark, at, documents, labels, items):
    documents.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_edges(spark, tmp_path):
    """Null and blank texts stay and are packed as separators; of the equal texts one stays; extra columns travel along."""
    rows = edges(spark)
    at = tables(spark, tmp_path, rows.withColumn("gone", F.lit(1)).withColumn("drop_id", F.lit(2)).withColumn("n_lines_dropped", F.lit(3)), [(1, None), (None, 1)], [(None, None), (1, "")])
    got = corpus_pipeline.run(spark, at).orderBy("doc_id", "length").collect()
    # the texts under 4 are alike and share their place: both stay; 5 repeats their line and goes
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 6] and [r.length for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    d = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, d, at).columns) == sorted(d.columns)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, none(spark), [], [])).count() == 0


def test_emptied_documents_are_not_packed(spark, tmp_path):
    line = "one line of some eight words to repeat"
    d = docs(spark, [line, line + "!", f"{line}\nand another line that stays as it is", "", line.upper()])
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, d, [(0, 0)], [(1, "x y z")])).collect()
    assert sorted({r.doc_id for r in got}) == [0, 2, 3]
