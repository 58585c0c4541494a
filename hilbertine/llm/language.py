"""Language identification of mixed texts.

A word's scripts, by ranges of code points, narrow the languages it may
belong to. Its score under each of these is the log-likelihood of its
character trigrams, the word's edges included. A Viterbi pass over a
document's words, in which a change of language costs a penalty, labels
spans; the document's language is the one with the most letters.

Counts cover every document that may be learnt from; their tables have a
bounded size for each language.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import SKETCH_SCHEMA, sketch_batch, summed_sketch

#: Slots of trigrams for each language.
SLOTS = 1 << 16
#: Cost of a change of language, in nats; added count of each slot; least share of a language's letters in a script that it is taken to use.
SWITCH, SMOOTHING, LEAST_SHARE = 8.0, 0.1, 0.01
#: Letters that are scored at a time, and word scores that one Viterbi pass holds.
RUN_CHARS, PASS_SCORES = 1 << 18, 1 << 23
UNKNOWN = "und"

# First code points of the ranges in which a script's letters lie; what lies between is "other".
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "ipa"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0700, 0x074F, "syriac"), (0x0750, 0x077F, "arabic"), (0x0780, 0x07BF, "thaana"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B00, 0x0B7F, "oriya"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"),
    (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x0F00, 0x0FFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x13A0, 0x13FF, "cherokee"), (0x1780, 0x17FF, "khmer"), (0x1800, 0x18AF, "mongolian"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x2C60, 0x2C7F, "latin"), (0x3040, 0x30FF, "kana"), (0x3130, 0x318F, "hangul"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"), (0xFB50, 0xFDFF, "arabic"),
    (0xFE70, 0xFEFF, "arabic"), (0xFF66, 0xFF9F, "kana"), (0x20000, 0x3FFFF, "han"),
]
NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form if a letter, or else 0; and the bit of its script, or else 0."""
    n = sys.maxunicode + 1
    lower, script = np.zeros(n, np.uint32), np.zeros(n, np.uint64)
    for i in range(0x40000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            small = c.lower()
            lower[i] = ord(small) if len(small) == 1 else i
    letters = lower > 0
    script[letters] = 1
    for first, last, name in SCRIPTS:
        part = slice(first, last + 1)
        script[part] = np.where(letters[part], np.uint64(1) << np.uint64(NAMES.index(name)), np.uint64(0))
    return lower, script


class Words:
    """The words (runs of letters) of some texts: row, first code point in it, length, script bits, and trigram slots by letter."""

    def __init__(self, texts: list[str]) -> None:
        lower, script = _tables()
        joined = "\n".join(texts)
        raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=begin[1:])
        c = np.zeros(len(raw) + 2, np.uint32)
        c[1:-1] = lower[raw]
        inside = c > 0
        start = np.flatnonzero(inside[1:] & ~inside[:-1])
        end = np.flatnonzero(inside[:-1] & ~inside[1:])
        at = np.flatnonzero(inside[1:-1]) + 1
        mixed = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA77) + c[at + 1] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        self.slots = mixed >> np.uint32(16)
        self.length = end - start
        self.first_letter = np.cumsum(self.length) - self.length
        self.row = np.searchsorted(begin, start, "right") - 1
        self.start = start - begin[self.row]
        self.scripts = np.bitwise_or.reduceat(script[raw[at - 1]], self.first_letter) if len(start) else np.zeros(0, np.uint64)
        self.letter_scripts = script[raw[at - 1]]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= RUN_CHARS:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


class Model:
    """Log-probabilities of trigram slots by language, and which scripts a language uses."""

    def __init__(self, languages: list[str], trigrams: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        counts = trigrams.astype(np.float64) + SMOOTHING
        self.log = np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T, dtype=np.float32)  # slot, language
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.uses = ((share >= LEAST_SHARE).astype(np.uint64) << np.arange(scripts.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)

    def word_scores(self, words: Words) -> np.ndarray:
        """Score of each word under each language; a language that lacks one of its scripts is left out, unless all do."""
        if not len(words.length):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.log[words.slots], words.first_letter, axis=0)
        kinds, which = np.unique(words.scripts, return_inverse=True)
        fits = (kinds[:, None] & ~self.uses[None, :]) == 0
        fits[~fits.any(1)] = True
        if not fits.all():
            scores[~fits[which]] = -1e6
        return scores


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word of each document, documents side by side.

    ``scores``: words by labels; a document has ``count`` words from ``first`` on.
    A change of label costs ``switch``; of equal labels the first is taken.
    """
    label = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    first, count = first[count > 0], count[count > 0]
    if not len(count):
        return label
    kinds = scores.shape[1]
    active = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")  # documents with more than t words
    best = scores[first].astype(np.float64)
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(kinds, dtype=np.int16)
    for t in range(1, int(count[0])):
        n = active[t]
        at, v = first[:n] + t, best[:n]
        top = v.argmax(1)
        moved = v[np.arange(n), top] - switch
        stay = v >= moved[:, None]
        back[at] = np.where(stay, own, top[:, None].astype(np.int16))
        best[:n] = np.where(stay, v, moved[:, None]) + scores[at]
    state = best.argmax(1).astype(np.int16)
    for t in range(int(count[0]) - 1, -1, -1):
        n = active[t]
        at, s = first[:n] + t, state[:n]
        label[at] = s
        if t:
            state[:n] = back[at, s]
    return label


def train(docs: DataFrame, where: Column | None = None) -> Model:
    """Learn from text and lang of all rows of ``docs`` with a lang that pass ``where``."""
    rows = docs.filter(F.lit(True) if where is None else where).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    width = SLOTS + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * width, np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            of = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, part in _parts(batch.column(1).to_pylist()):
                w = Words(part)
                base = np.repeat(of[first + w.row] * width, w.length)
                cell, n = np.unique(np.concatenate([base + w.slots, base + SLOTS + np.log2(np.maximum(w.letter_scripts, 1)).astype(np.int64)]), return_counts=True)
                total[cell] += n
        yield sketch_batch(total)

    counts = summed_sketch(rows.mapInArrow(count, SKETCH_SCHEMA), len(languages) * width).reshape(len(languages), width)
    return Model(languages, counts[:, :SLOTS], counts[:, SLOTS:])


def _labelled(model: Model, texts: list[str | None], switch: float) -> Iterator[tuple[str, float, str]]:
    """Language, share of letters and spans of each text, in order."""
    pending: list[tuple[Words, np.ndarray, int]] = []
    held = 0
    for _, part in _parts(texts):
        w = Words(part)
        pending.append((w, model.word_scores(w), len(part)))
        held += pending[-1][1].size
        if held >= PASS_SCORES:
            yield from _resolved(model, pending, switch)
            pending, held = [], 0
    if pending:
        yield from _resolved(model, pending, switch)


def _resolved(model: Model, pending: list, switch: float) -> Iterator[tuple[str, float, str]]:
    shift = np.cumsum([0] + [n for _, _, n in pending])
    row = np.concatenate([w.row + s for (w, _, _), s in zip(pending, shift, strict=False)])
    start, length = (np.concatenate([getattr(w, k) for w, _, _ in pending]) for k in ("start", "length"))
    n, kinds = int(shift[-1]), len(model.languages)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    if not kinds:
        for k in range(n):
            yield UNKNOWN, 0.0, ""
        return
    label = viterbi(np.concatenate([s for _, s, _ in pending]), first, count, switch)
    letters = np.bincount(row * kinds + label, weights=length, minlength=n * kinds).reshape(n, kinds)
    best, total = letters.argmax(1), letters.sum(1)
    turns = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    last = np.append(turns[1:], len(row)) - 1
    of_turn = np.searchsorted(row[turns], np.arange(n + 1)) if len(turns) else np.zeros(n + 1, np.int64)
    for k in range(n):
        if not count[k]:
            yield UNKNOWN, 0.0, ""
            continue
        spans = ",".join(f"{model.languages[label[a]]}:{start[a]}:{start[b] + length[b]}" for a, b in zip(turns[of_turn[k] : of_turn[k + 1]], last[of_turn[k] : of_turn[k + 1]], strict=True))
        yield model.languages[best[k]], float(letters[k, best[k]] / total[k]), spans


def identify(docs: DataFrame, model: Model, held_out: Column | None = None, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the letters in that language) and spans.

    spans lists lang:start:end (code points, end exclusive) of each stretch of
    one language. A text that is null or has no letter is 'und' with score 0 and no
    spans. Of languages with equally many letters the first by name is taken. A
    null doc_id is kept and not held out; repeated rows are each labelled;
    an empty table gives no rows; other columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(_labelled(shared.value, batch.column(2).to_pylist(), switch))
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(label, "doc_id bigint, held_out boolean, lang_pred string, score double, spans string")
