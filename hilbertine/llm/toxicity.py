"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, give a text's
log-likelihoods; their difference for each word is the evidence. Each model
discounts its bigrams towards its own continuation counts (after how many different words a
word stands), and those towards the continuation counts of both classes together, so that
expressions that a class has hardly seen get the same probability from both.

Every word of every labelled row that may be learnt from is counted, and so is every stem (a word's
first bytes). Those that are at least twice as common in toxic documents, by more than chance explains among as many
tokens as there are, are told apart by the models; the others have shared
counts alone and stand as one unknown word. How many are told apart follows the corpus. A word that is not counts by its
stem if that is, so that inflected forms share their evidence. Likewise a pair of words is told apart where
the classes use it more differently than chance and the word itself explain; other pairs have
the evidence of the word. Only the last step, turning
evidence into a probability, is fitted on a sample of about ``SAMPLE`` rows, drawn
by hash, each scored by a model that has not seen it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import toxicity_tables
from .scratch import materialise
from .text import U64, byte_class, mix, runs, word_hashes, words

#: Rows that fit the last step.
SAMPLE = 20_000
STEM_BYTES = 4
#: How much commoner in toxic documents a token must be; with many documents, chance alone would let the words of a language pass.
LEAST_RATIO = 2
#: Most tokens and pairs told apart that are broadcast, some 20 MB; beyond, all of them stay in tables and are joined (``toxicity_tables``).
MOST_TOKENS, MOST_PAIRS = 1 << 18, 1 << 20
DISCOUNT = 0.75
THRESHOLD = 0.3
#: Keys that a task sums up before it hands them on.
TALLY = 1 << 20
#: Least hashes by which the different pairs of words are counted.
KEPT_HASHES = 1024

LETTERS = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
STEM_MARK = U64(0xA5A5A5A55A5A5A5B)


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(by))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word hash and stem hash of each word."""
    row, start, end = words(data, offsets, LETTERS)
    return row, word_hashes(data, start, end), word_hashes(data, start, np.minimum(end, start + STEM_BYTES)) ^ STEM_MARK


class Vocabulary:
    """Token hashes in order; id 0 is the unknown word and the beginning of a text."""

    def __init__(self, tokens: list[int]) -> None:
        self.tokens = np.sort(np.asarray(tokens, np.int64).view(U64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.tokens)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h & U64((1 << 20) - 1)).astype(np.int64)

    def ids(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        out = self._find(word)
        rest = np.flatnonzero(out == 0)
        out[rest] = self._find(stem[rest])
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(self.maybe[self._slot(h)])
        if len(self.tokens) and len(some):
            at = np.searchsorted(self.tokens, h[some])
            at[at == len(self.tokens)] = 0
            out[some] = np.where(self.tokens[at] == h[some], at + 1, 0)
        return out


class Counts:
    """One class: continuation counts by word; the bigrams told apart (keys ``before * size + word``, in order, and counts);
    and by the word before, how many bigrams and how many different ones there are in all."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, continuation: np.ndarray, seen: np.ndarray, kinds: np.ndarray) -> None:
        self.keys, self.n, self.continuation, self.seen, self.kinds = keys, *(x.astype(np.float64) for x in (n, continuation, seen, kinds))


class KneserNey:
    """P(word) and P(word | word before) of one class, interpolated down to its continuation counts and to those of both classes."""

    def __init__(self, counts: Counts, shared: np.ndarray, discount: float = DISCOUNT) -> None:
        size, total = len(shared), counts.continuation.sum()
        both = (shared + 1) / (shared + 1).sum()
        kept = np.maximum(counts.continuation - discount, 0)
        self.single = (kept + (total - kept.sum()) * both) / total if total else both
        self.rest = np.where(counts.seen > 0, discount * counts.kinds / np.maximum(counts.seen, 1), 1.0)  # what a word before leaves to single words
        before, word = counts.keys // size, counts.keys % size
        self.pair = np.maximum(counts.n - discount, 0) / np.maximum(counts.seen[before], 1) + self.rest[before] * self.single[word]


class Evidence:
    """log P(word | before, toxic) - log P(word | before, ordinary) for the bigrams told apart, and log P(word, toxic) - log P(word, ordinary) for the others."""

    def __init__(self, toxic: Counts, ordinary: Counts, shared: np.ndarray) -> None:
        t, o = KneserNey(toxic, shared), KneserNey(ordinary, shared)
        self.size, self.keys = len(shared), toxic.keys
        self.word, self.pair = np.log(t.single) - np.log(o.single), np.log(t.pair) - np.log(o.pair)

    def of(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = self.word[word]
        known = np.flatnonzero((before > 0) | (word > 0))
        if len(self.keys) and len(known):
            key = before[known] * self.size + word[known]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[known[hit]] = self.pair[at[hit]]
        return out


def _with_before(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id before each word, 0 at a text's beginning."""
    before = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
    before[np.flatnonzero(np.diff(row, prepend=-1))] = 0
    return before


def _text_evidence(texts: pa.Array, vocabulary: Vocabulary, tables: list[Evidence], which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Summed evidence and number of words of each text, by runs of texts; ``which`` table a text uses."""
    for base, data, offsets in runs(texts):
        n = len(offsets) - 1
        row, word, stem = _tokens(data, offsets)
        ids = vocabulary.ids(word, stem)
        before = _with_before(row, ids)
        each = tables[0].of(before, ids)
        if which is not None:
            each = np.where(which[base : base + n][row] == 0, each, tables[1].of(before, ids))
        yield np.bincount(row, weights=each, minlength=n), np.bincount(row, minlength=n)


def _features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length-normalised evidence: per word, and per square root of the words."""
    return np.stack([total / np.maximum(n, 1), total / np.sqrt(np.maximum(n, 1)), np.ones(len(n))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column of ``x`` is constant."""
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    x = x / scale
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w / scale


def rising_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights under which more evidence never lowers the score: a feature with a negative weight goes."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[use] = fit_logistic(x[:, use], y)
        wrong = (w[:-1] < 0) & use[:-1]
        if not wrong.any():
            return w
        use[:-1] &= ~wrong


class Model:
    """A vocabulary, the evidence of its bigrams, and the weights that make it a probability."""

    def __init__(self, vocabulary: Vocabulary, table: Evidence, weights: np.ndarray) -> None:
        self.vocabulary, self.table, self.weights = vocabulary, table, weights

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(_features(t, n) @ self.weights, -30, 30))) for t, n in _text_evidence(texts, self.vocabulary, [self.table])]
        return np.concatenate(out) if out else np.zeros(0)


def _training(docs: DataFrame, labels: DataFrame, where: Column) -> DataFrame:
    """(toxic, fold, size, packed) of each document with a label; texts travel compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(r) for r in raw], pa.int32()), pa.array([pa.compress(r, codec="zstd", asbytes=True) if r else b"" for r in raw], pa.binary())],
                names=["doc_id", "fold", "size", "packed"],
            )

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(where)
    packed = rows.select("doc_id", fold.alias("fold"), "text").mapInArrow(pack, "doc_id bigint, fold int, size int, packed binary")
    marks = labels.select(F.col("doc_id").cast("long").alias("label_of"), F.col("toxic").cast("int").alias("toxic")).na.drop().groupBy("label_of").agg(F.max("toxic").alias("toxic"))
    # labels grow with the documents: the same join at every size
    return packed.join(marks.hint("merge"), F.col("doc_id") == F.col("label_of")).select(F.expr("if(toxic > 0, 1, 0)").alias("toxic"), "fold", "size", "packed", F.xxhash64("doc_id").alias("h"))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Parts of a batch of training rows: their indices and texts."""
    sizes = np.asarray(batch.column(2))
    for at in range(0, batch.num_rows, 256):
        rows = np.arange(at, min(at + 256, batch.num_rows))
        texts = [pa.decompress(batch.column(3)[int(i)].as_py(), decompressed_size=int(sizes[i]), codec="zstd", asbytes=True).decode() if sizes[i] else "" for i in rows]
        yield rows, pa.array(texts, pa.string())


class _Tally:
    """Counts of 64-bit keys, summed up before they leave a task."""

    def __init__(self) -> None:
        self.keys, self.n, self.waiting, self.ready = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.ready += len(keys)
        if self.ready > TALLY:
            self._sum()

    def _sum(self) -> None:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.waiting]), return_counts=True)
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.keys, self.n = both, np.bincount(at, weights=np.concatenate([self.n, n]), minlength=len(both)).astype(np.int64)
        self.waiting, self.ready = [], 0

    def taken(self, least: int = TALLY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What has been summed up, if there are at least so many keys."""
        if self.ready and least == 0:
            self._sum()
        if len(self.keys) >= max(least, 1):
            yield self.keys, self.n
            self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)


COLUMNS = ("toxic", "fold", "size", "packed")


def _token_documents(training: DataFrame) -> DataFrame:
    """(token, n0, n1): in how many ordinary and toxic documents each word and each stem stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (_Tally(), _Tally())

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            for c, tally in enumerate(tallies):
                for keys, n in tally.taken(least):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), c, np.int32)), pa.array(n)], names=["token", "toxic", "n"])

        for batch in batches:
            toxic = np.asarray(batch.column(0))
            for at, texts in _unpacked(batch):
                for base, data, offsets in runs(texts):
                    row, word, stem = _tokens(data, offsets)
                    for h in (word, stem):  # a document counts once for each token
                        order = np.lexsort((h, row))
                        r, t = row[order], h[order]
                        new = np.ones(len(r), bool)
                        new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
                        of = toxic[at[base] + r]
                        for c in (0, 1):
                            tallies[c].add(t[new & (of == c)].view(np.int64))
            yield from rows(TALLY)
        yield from rows(0)

    each = training.select(*COLUMNS).mapInArrow(count, "token bigint, toxic int, n bigint")
    return each.groupBy("token").agg(F.sum(F.expr("if(toxic = 0, n, 0)")).alias("n0"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("n1"))


def departure(n0: str, n1: str, share: str) -> str:
    """SQL for the log-likelihood ratio (G squared) of counts n0 and n1 against a ``share`` expected of n1."""
    part = lambda n, p: f"if({n} > 0, {n} * ln({n} / (({n0} + {n1}) * ({p}))), 0D)"
    return f"2 * ({part(n1, share)} + {part(n0, f'1 - {share}')})"


def leaning(ordinary: int, toxic: int) -> str:
    """SQL for the G squared of a token (n0, n1: documents with it) if it is ``LEAST_RATIO`` times as common in toxic documents; 0 if it is not."""
    expected = f"{toxic / (ordinary + toxic)!r}D"
    without = departure(f"({ordinary} - n0)", f"({toxic} - n1)", expected)
    return f"if(n1 * {ordinary}D >= {LEAST_RATIO} * n0 * {toxic}D, {departure('n0', 'n1', expected)} + {without}, 0D)"


def _vocabulary(training: DataFrame, ordinary: int, toxic: int, most: int) -> Vocabulary | DataFrame:
    """The tokens whose leaning among so many tokens is more than chance: fewer than one would lean so far by chance.

    More than ``most`` stay in a table (token).
    """
    if not ordinary or not toxic:
        return Vocabulary([])
    tokens = materialise(_token_documents(training).withColumn("lean", F.expr(leaning(ordinary, toxic))).select("token", "lean"))
    level = 2 * math.log(max(2, tokens.count()))
    lean = tokens.filter(F.col("lean") >= level).select("token")
    if lean.limit(most + 1).count() > most:
        return materialise(lean)
    return Vocabulary([r[0] for r in lean.collect()])


def _bigrams(training: DataFrame, vocabulary, size: int) -> DataFrame:
    """(part, what, key, n) by class and fold (part), of three kinds.

    0: n bigrams of ids, key being ``before * size + word``; 1: a known word (key) after a word
    of the hash n; 2: a hash (key) among the least of all pairs of words.
    """
    names = ["part", "what", "key", "n"]

    def batch_of(what: int, part: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), what, np.int32)), pa.array(key), pa.array(n)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, least = _Tally(), {}
        for batch in batches:
            toxic, fold = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            for at, texts in _unpacked(batch):
                for base, data, offsets in runs(texts):
                    row, word, stem = _tokens(data, offsets)
                    ids = vocabulary.value.ids(word, stem)
                    part = (2 * toxic + fold)[at[base] + row]
                    pairs.add((_with_before(row, ids) * size + ids) * 4 + part)
                    before = mix(_with_before(row, word.view(np.int64)).view(U64))
                    known = np.flatnonzero(ids > 0)
                    yield batch_of(1, part[known], ids[known], before[known].view(np.int64))
                    kind = mix(before + word)
                    for p in np.unique(part).tolist():
                        least[p] = np.unique(np.concatenate([least.get(p, np.zeros(0, U64)), kind[part == p]]))[:KEPT_HASHES]
            for key, n in pairs.taken():
                yield batch_of(0, key % 4, key // 4, n)
        for key, n in pairs.taken(0):
            yield batch_of(0, key % 4, key // 4, n)
        for p, h in least.items():
            yield batch_of(2, np.full(len(h), p), (h >> U64(1)).astype(np.int64), np.ones(len(h), np.int64))

    return materialise(training.select(*COLUMNS).mapInArrow(count, "part int, what int, key bigint, n bigint").distinct())


def different(least: np.ndarray) -> float:
    """An estimate of how many different hashes there are, from the least ones of 63 bits."""
    return float(len(least)) if len(least) < KEPT_HASHES else (KEPT_HASHES - 1) / (float(least[KEPT_HASHES - 1]) / 2.0**63)


class _Corpus:
    """What the models are made of, for any choice of folds: bounded by the tokens and pairs told apart.

    Where there are more than ``most_pairs`` pairs, ``pairs`` is None, and nothing else is gathered.
    """

    def __init__(self, counted: DataFrame, size: int, most_pairs: int = MOST_PAIRS) -> None:
        self.size = size
        by_part = [F.sum(F.expr(f"if(part = {p}, n, 0)")).alias(f"n{p}") for p in range(4)]
        pairs = materialise(counted.filter("what = 0").groupBy("key").agg(*by_part).selectExpr("*", f"key div {size} as b", f"key % {size} as w"))
        sums = [F.sum(f"n{p}").alias(f"n{p}") for p in range(4)]
        kinds = [F.count_if(F.expr(" + ".join(f"n{p}" for p in c) + " > 0")).alias("k" + "".join(map(str, c))) for c in ((0,), (1,), (2,), (3,), (0, 1), (2, 3))]
        # a word's own share of toxic uses is what a pair is held against; at most MOST_TOKENS rows
        words_ = pairs.groupBy("w").agg(F.expr("(sum(n2 + n3) + 0.5D) / (sum(n0 + n1 + n2 + n3) + 1D) as share"))
        held = pairs.join(F.broadcast(words_), "w").withColumn("g", F.expr(departure("(n0 + n1)", "(n2 + n3)", "share"))).filter("b > 0 or w > 0")
        level = 2 * math.log(max(2, held.count()))
        apart = held.filter(F.col("g") >= level)
        if apart.limit(most_pairs + 1).count() > most_pairs:
            self.pairs = None
            return
        self.seen = pairs.groupBy("b").agg(*sums, *kinds).toPandas().set_index("b").reindex(range(size), fill_value=0)
        self.pairs = apart.select("key", "n0", "n1", "n2", "n3").toPandas().sort_values("key")
        after = counted.filter("what = 1").groupBy("key", "n").agg(F.expr("bit_or(cast(shiftleft(1, part) as int))").alias("parts"))
        self.after = after.groupBy("key", "parts").agg(F.count("*").alias("n")).toPandas()  # words before, by the parts that they are found in

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least: dict[int, np.ndarray] = {}
            for batch in batches:
                part, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for p in np.unique(part).tolist():
                    least[p] = np.unique(np.concatenate([least.get(p, np.zeros(0, np.int64)), key[part == p]]))[:KEPT_HASHES]
            for p, h in least.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), p, np.int32)), pa.array(h)], names=["part", "key"])

        kinds_ = counted.filter("what = 2").select("part", "key")
        # many tasks first, each with a share of the hashes; what they leave has a bound
        some = kinds_.repartition(F.col("part"), F.pmod("key", F.lit(64))).mapInArrow(merge, "part int, key bigint")
        self.least = some.repartition("part").mapInArrow(merge, "part int, key bigint").toPandas()

    def _continuation(self, parts: list[int]) -> np.ndarray:
        chosen = sum(1 << p for p in parts)
        rows = self.after[(self.after["parts"] & chosen) != 0]
        out = np.bincount(rows["key"].to_numpy(), weights=rows["n"].to_numpy(), minlength=self.size)
        least = np.unique(self.least[self.least["part"].isin(parts)]["key"].to_numpy())[:KEPT_HASHES]
        out[0] = max(0.0, different(least) - out.sum())
        return out

    def evidence(self, folds: tuple[int, ...] = (0, 1)) -> Evidence:
        counts = []
        for c in (0, 1):
            parts = [2 * c + f for f in folds]
            n, seen = (x[[f"n{p}" for p in parts]].sum(axis=1).to_numpy() for x in (self.pairs, self.seen))
            counts.append(Counts(self.pairs["key"].to_numpy(np.int64), n, self._continuation(parts), seen, self.seen["k" + "".join(map(str, parts))].to_numpy()))
        return Evidence(counts[1], counts[0], self._continuation([2 * c + f for c in (0, 1) for f in folds]))


def _weights(rows: pd.DataFrame) -> np.ndarray:
    """Weights of the features fitted on rows (toxic, total, n)."""
    y = rows["toxic"].to_numpy()
    if len(rows) and 0 < y.sum() < len(y):
        return rising_weights(_features(rows["total"].to_numpy(), rows["n"].to_numpy()), y)
    share = (y.sum() + 0.5) / (len(y) + 2.5)  # one class only: its share is all that is known
    return np.array([0.0, 0.0, np.log(share / (1 - share))])


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE, most_tokens: int = MOST_TOKENS, most_pairs: int = MOST_PAIRS) -> Model | toxicity_tables.Tables:
    """Learn from the labelled rows of ``docs`` that pass ``where``.

    Labels that are null, or of no document, are passed over; of several labels of
    a document the largest counts. Without labels the model takes every text for ordinary. More than
    ``most_tokens`` tokens or ``most_pairs`` pairs told apart are not gathered: the model is tables then, which scoring joins.
    """
    training = materialise(_training(docs, labels, F.lit(True) if where is None else where))
    by_class = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    vocabulary = _vocabulary(training, by_class.get(0, 0), by_class.get(1, 0), most_tokens)
    share = min(1.0, sample / max(1, sum(by_class.values())))
    few = training.filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * share)).select(*COLUMNS)
    corpus = None
    if isinstance(vocabulary, Vocabulary):
        context, size = docs.sparkSession.sparkContext, len(vocabulary.tokens) + 1
        used = context.broadcast(vocabulary)
        corpus = _Corpus(_bigrams(training, used, size), size, most_pairs)
    if corpus is None or corpus.pairs is None:
        tokens = docs.sparkSession.createDataFrame([(t,) for t in vocabulary.tokens.view(np.int64).tolist()], "token long") if corpus else vocabulary
        tables = toxicity_tables.learnt(training, tokens)
        tables.weights = _weights(toxicity_tables.held(tables, few).toPandas())
        return tables
    crossed = context.broadcast([corpus.evidence((1,)), corpus.evidence((0,))])  # a row of fold 0 is scored by the counts of fold 1

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column(1))
            for rows, texts in _unpacked(batch):
                got = list(_text_evidence(texts, used.value, crossed.value, fold[rows]))
                total, n = (np.concatenate([g[i] for g in got]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(total), pa.array(n.astype(np.int64))], names=["toxic", "total", "n"])

    weights = _weights(few.mapInArrow(held, "toxic int, total double, n bigint").toPandas())
    return Model(vocabulary, corpus.evidence(), weights)


def score_documents(docs: DataFrame, model: Model | toxicity_tables.Tables, held_out: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more likely toxic) and predicted (1 from ``threshold`` on).

    A null or empty text has no evidence and gets the score of that. Every row
    is scored by its text alone; a null doc_id is kept and not held out; an
    empty table gives no rows; other columns are not used.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    if isinstance(model, toxicity_tables.Tables):
        return toxicity_tables.score_documents(docs, model, held, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model | toxicity_tables.Tables, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more; all columns are kept.

    A null or empty text is scored as one without words. Every row is judged by its text
    alone, also those that repeat a doc_id. An empty table gives an empty one.
    """
    if isinstance(model, toxicity_tables.Tables):
        return toxicity_tables.keep_ordinary(docs, model, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(place)) < threshold))

    return docs.mapInArrow(keep, docs.schema)
