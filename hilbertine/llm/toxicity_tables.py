"""The toxicity model as tables, for more tokens or pairs than are broadcast.

The same counts, the same significance and the same smoothing as in ``toxicity``, with nothing left out: words find
their tokens, and pairs their evidence, by joins, so that neither the driver nor a task holds a table whole. A token is its own id,
and 0 the unknown word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import toxicity as tox
from .scratch import materialise
from .text import runs

#: Choices of folds that evidence is made of, by the suffix of its columns.
FOLDS = {"": (0, 1), "0": (0,), "1": (1,)}
OCCURRENCE = "uid bigint, word bigint, stem bigint, before bigint, before_stem bigint"


def _masks(folds: tuple[int, ...]) -> tuple[int, int, int]:
    """Bits of the parts (2 x toxic + fold) of ordinary, toxic and all documents."""
    ordinary, toxic = sum(1 << f for f in folds), sum(4 << f for f in folds)
    return ordinary, toxic, ordinary | toxic


MASKS = sorted({m for folds in FOLDS.values() for m in _masks(folds)})


def occurrences(rows: DataFrame, packed: bool) -> DataFrame:
    """A row for each word: the row's uid, hashes of the word and its stem, and of the word before (0 at a text's beginning). ``rows``: uid, text or uid, size, packed."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tox._unpacked(batch) if packed else [(np.arange(batch.num_rows), batch.column(1))]:
                for base, data, offsets in runs(texts):
                    row, word, stem = tox._tokens(data, offsets)
                    word, stem = word.view(np.int64), stem.view(np.int64)
                    columns = [pa.array(c) for c in (word, stem, tox._with_before(row, word), tox._with_before(row, stem))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[base + row])), *columns], names=["uid", "word", "stem", "before", "before_stem"])

    return rows.select(*(["uid", F.lit(0), "size", "packed"] if packed else ["uid", "text"])).mapInArrow(emit, OCCURRENCE)


def _with_ids(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """``found`` with the ids of each word (w) and of the word before (b): the word if it is told apart, else its stem if that is, else 0."""
    each = found.select("word", "stem").union(found.select("before", "before_stem")).distinct()
    known = each.join(tokens.selectExpr("token as word", "token as __whole"), "word", "left").join(tokens.selectExpr("token as stem", "token as __stem"), "stem", "left")
    known = materialise(known.selectExpr("word", "coalesce(__whole, __stem) as id").filter("id is not null").dropDuplicates(["word"]))
    met = found.join(known.withColumnRenamed("id", "w"), "word", "left").join(known.selectExpr("word as before", "id as b"), "before", "left")
    return met.na.fill(0, ["w", "b"])


def _words(ids: DataFrame, tokens: DataFrame) -> DataFrame:
    """id, and for each choice of folds its probability in ordinary (o) and toxic (t) documents and the evidence (e) of that."""
    part = F.expr("shiftleft(1, cast(uid as int))")
    of = [F.count_if(F.expr(f"(parts & {m}) <> 0")).alias(f"c{m}") for m in MASKS]
    after = ids.filter("w <> 0").groupBy("w", "before").agg(F.bit_or(part).alias("parts")).groupBy("w").agg(*of)
    counted = materialise(tokens.selectExpr("token as id").join(after.withColumnRenamed("w", "id"), "id", "left").na.fill(0))
    kinds = ids.groupBy("before", "word").agg(F.bit_or(part).alias("parts")).agg(*of).first()
    sums = counted.agg(*[F.coalesce(F.sum(f"c{m}"), F.lit(0)).alias(f"c{m}") for m in MASKS]).first()
    unknown = counted.sparkSession.createDataFrame([(0, *[max(0, kinds[f"c{m}"] - sums[f"c{m}"]) for m in MASKS])], counted.schema)
    counted = counted.unionByName(unknown)
    d, each = tox.DISCOUNT, [f(m) for m in MASKS for f in (lambda m: F.sum(f"c{m}").alias(f"c{m}"), lambda m: F.sum(F.greatest(F.col(f"c{m}") - tox.DISCOUNT, F.lit(0.0))).alias(f"k{m}"))]
    all_ = counted.agg(F.count("*").alias("size"), *each).first()
    for e, folds in FOLDS.items():
        ordinary, toxic, both = _masks(folds)
        shared = f"((c{both} + 1) / {float(all_[f'c{both}'] + all_['size'])!r}D)"
        for name, m in (("o", ordinary), ("t", toxic)):
            total = float(all_[f"c{m}"])
            counted = counted.withColumn(f"{name}{e}", F.expr(f"(greatest(c{m} - {d}D, 0D) + {total - all_[f'k{m}']!r}D * {shared}) / {total!r}D" if total else shared))
        counted = counted.withColumn(f"e{e}", F.expr(f"ln(t{e}) - ln(o{e})"))
    return materialise(counted.select("id", *[f"{k}{e}" for e in FOLDS for k in "ote"]))


def _pairs(ids: DataFrame, words: DataFrame) -> DataFrame:
    """b, w and, for each choice of folds, the evidence (p) of the pairs told apart."""
    pairs = materialise(ids.groupBy("b", "w").agg(*[F.sum(F.expr(f"if(uid = {p}, n, 0)")).alias(f"n{p}") for p in range(4)]))
    n = {(c, e): " + ".join(f"n{2 * c + f}" for f in folds) for c in (0, 1) for e, folds in FOLDS.items()}
    seen = pairs.groupBy("b").agg(*[a for (c, e), s in n.items() for a in (F.sum(F.expr(s)).alias(f"s{c}_{e}"), F.count_if(F.expr(f"{s} > 0")).alias(f"k{c}_{e}"))])
    shares = pairs.groupBy("w").agg(F.expr("(sum(n2 + n3) + 0.5D) / (sum(n0 + n1 + n2 + n3) + 1D) as share"))
    held = pairs.filter("b <> 0 or w <> 0").join(shares, "w").withColumn("g", F.expr(tox.departure("(n0 + n1)", "(n2 + n3)", "share")))
    apart = held.filter(F.col("g") >= 2 * math.log(max(2, held.count()))).join(seen, "b").join(words.withColumnRenamed("id", "w"), "w")
    d = tox.DISCOUNT
    p = {(c, e): f"(greatest({s} - {d}D, 0D) / greatest(s{c}_{e}, 1) + if(s{c}_{e} > 0, {d}D * k{c}_{e} / s{c}_{e}, 1D) * {'ot'[c]}{e})" for (c, e), s in n.items()}
    return materialise(apart.select("b", "w", *[F.expr(f"ln({p[1, e]}) - ln({p[0, e]})").alias(f"p{e}") for e in FOLDS]))


class Tables:
    """A model whose tokens, words and pairs stay in tables; ``weights`` make evidence a probability."""

    def __init__(self, tokens: DataFrame, words: DataFrame, pairs: DataFrame, weights: np.ndarray | None = None) -> None:
        self.tokens, self.words, self.pairs, self.weights = tokens, words, pairs, weights
        self.unknown = words.filter("id = 0").first().asDict()

    def sums(self, found: DataFrame, choices: tuple[str, ...] = ("",)) -> DataFrame:
        """uid, n (words) and the summed evidence of each choice of folds (total), for each text that has a word.

        Words that are unknown after unknown ones all have the same evidence and meet no table.
        """
        known = _with_ids(found, self.tokens).filter("b <> 0 or w <> 0").withColumn("w", F.expr("nullif(w, 0)"))
        met = known.join(self.words.filter("id <> 0").withColumnRenamed("id", "w"), "w", "left").withColumn("w", F.coalesce("w", F.lit(0)))
        met = met.join(self.pairs, ["b", "w"], "left")
        more = met.groupBy("uid").agg(*[F.sum(F.expr(f"coalesce(p{e}, e{e}, {self.unknown[f'e{e}']!r}D) - {self.unknown[f'e{e}']!r}D")).alias(f"more{e}") for e in choices])
        all_ = found.groupBy("uid").agg(F.count("*").alias("n")).join(more, "uid", "left")
        return all_.select("uid", "n", *[F.expr(f"round(coalesce(more{e}, 0D) + n * {self.unknown[f'e{e}']!r}D, 9)").alias(f"total{e}") for e in choices])

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (uid, text, ...) with ``score``."""
        met = rows.join(self.sums(occurrences(rows, False)), "uid", "left").na.fill(0, ["n"]).na.fill(0.0, ["total"])
        a, b, c = (float(x) for x in self.weights)
        z = f"greatest(-30D, least(30D, {a!r}D * total / greatest(n, 1) + {b!r}D * total / sqrt(greatest(n, 1)) + {c!r}D))"
        return met.withColumn("score", F.expr(f"1 / (1 + exp(-({z})))")).drop("n", "total")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``uid``, written, so that a row keeps its number."""
    return materialise(docs.withColumn("uid", F.monotonically_increasing_id()))


def learnt(training: DataFrame, tokens: DataFrame) -> Tables:
    """The tables of a training set (toxic, fold, size, packed) for these tokens, without weights."""
    of_part = training.withColumn("uid", F.expr("cast(2 * toxic + fold as bigint)"))
    counted = materialise(occurrences(of_part, True).groupBy("uid", "word", "stem", "before", "before_stem").agg(F.count("*").alias("n")))
    ids = materialise(_with_ids(counted, tokens))
    words = _words(ids, tokens)
    return Tables(tokens, words, _pairs(ids, words))


def held(tables: Tables, few: DataFrame) -> DataFrame:
    """(toxic, total, n) of rows of the training set, each by the counts of the fold that it isn't in."""
    rows = numbered(few.select(*tox.COLUMNS))
    sums = tables.sums(occurrences(rows, True), ("0", "1"))
    met = rows.select("uid", "toxic", "fold").join(sums, "uid", "left")
    return met.select("toxic", F.expr("coalesce(if(fold = 0, total1, total0), 0D)").alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def score_documents(docs: DataFrame, model: Tables, held_out: Column, threshold: float) -> DataFrame:
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")))
    return model.scored(rows).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Tables, threshold: float) -> DataFrame:
    rows = numbered(docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text")))
    return model.scored(rows).filter(F.col("score") < threshold).select("doc.*")
