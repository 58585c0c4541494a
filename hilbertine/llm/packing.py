"""Best-fit packing of tokenised documents into sequences of fixed width.

Hierarchical residual packing: each task packs its own pieces best-fit
decreasing and emits the bins that are full enough; bins that are still
underfull travel up a tree as indivisible items, where tasks of the next level
merge them by the same rule, until one task is left.

Only few bins need to travel. Of the bins that a task has packed best-fit, no
two at most half full remain (they would share a bin), and a bin more than
half full can only take in another task's bin that is at most half full, of
which every sibling has at most one. So a task sends up its one small bin and
as many hosts, the emptiest first, as it has siblings, whatever its input.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

WIDTH = 2048
SEPARATOR = 0
#: Tasks merged into one at each level, and pieces that a task of the first level gets.
FAN_IN = 16
PIECES_PER_TASK = 32_768
#: Bins with less room than this are final.
NEARLY_FULL = 8
#: Entries of a worker's cache of encoded words; longer words are encoded each time.
CACHE_WORDS = 400_000
CACHE_CHARS = 48

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, piece_key bigint"
PACKED_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, task bigint, level int"

#: The characters below U+0100 by the tokenizer's classes; they compose with none of each other and lower-case one to one.
_SMALL, _NUMBERS, _BLANKS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
#: What the tokenizer cuts a lower-case text of such characters into.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_SMALL}]+|[{_NUMBERS}]|[^{_BLANKS}{_SMALL}{_NUMBERS}]+")
WORD = re.compile(f"[{_SMALL}]+")
WORD_END = "</w>"

_tokenizers: dict = {}


def _tokenizer(path: str) -> tuple:
    """A worker's tokenizer, which of its ids end a word, its added tokens' texts, and its cache of encoded stretches."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = [a.content.lower() for a in t.get_added_tokens_decoder().values()]
        vocabulary = t.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        _tokenizers[path] = (t, ends, special, {})
    return _tokenizers[path]


def _encode_words(words: list[str], tokenizer, ends: np.ndarray) -> list[bytes]:
    """The ids of plain lower-case words, encoded as one text and told apart by their last tokens."""
    if not words:
        return []
    ids = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
    cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
    if len(cuts) != len(words):  # a vocabulary without such ends
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def _parts(text: str) -> list[str]:
    """Stretches whose ids, one after the other, are the text's.

    No token spans white space. A text of characters below U+0100 is cut the
    whole way into the tokenizer's own parts, any other at blanks and line ends.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    return PARTS.findall(text.lower())


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers; parts seen before come from the worker's cache.

    A text that holds the text of an added token, such as the one for the end of a
    text, is given to the tokenizer whole, which finds these before anything else.
    """
    tokenizer, ends, special, cache = _tokenizer(path)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    whole = {}
    for i, text in enumerate(texts):
        low = text.lower()
        if any(s in low for s in special):
            whole[i] = np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    parts = [[] if i in whole else _parts(text) for i, text in enumerate(texts)]
    missing = set().union(*parts).difference(cache)
    words = [p for p in missing if WORD.fullmatch(p)]
    new = dict(zip(words, _encode_words(words, tokenizer, ends), strict=True))
    if len(new) < len(missing):
        other = list(missing.difference(new))
        new.update(zip(other, (np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))
    cache.update(new)
    for i, of_text in enumerate(parts):
        yield whole[i] if i in whole else b"".join(map(cache.__getitem__, of_text))
    for p in new:
        if len(p) > CACHE_CHARS:
            del cache[p]


def tokenised_pieces(docs: DataFrame, path: str, width: int = WIDTH) -> DataFrame:
    """One row for each piece of at most ``width`` tokens of each document.

    A null or empty text is the separator alone. Rows that repeat a doc_id are
    documents of their own.
    """
    end = np.asarray([SEPARATOR], "<u4").tobytes()
    size = 4 * width

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("piece_key", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode_texts([t or "" for t in part.column(1).to_pylist()], path), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), size)):
                        piece = ids[start : start + size]
                        rows.append((doc_id, k, start // 4, len(piece) // 4, zlib.crc32(piece), key))
                        key += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def best_fit(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills, by best-fit decreasing."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(width + 1)]
    some = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                some ^= 1 << room
        else:
            b, room = len(fills), width
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            with_room[room].append(b)
            some |= 1 << room
    return bin_of, offset, np.asarray(fills, np.int64)


def _going_up(fills: np.ndarray, width: int, nearly_full: int, fan_in: int) -> np.ndarray:
    """Which bins a task sends up; see the module's note."""
    up = np.zeros(len(fills), bool)
    by_fill = np.argsort(fills, kind="stable")
    by_fill = by_fill[width - fills[by_fill] > nearly_full]
    small = by_fill[2 * fills[by_fill] <= width]
    up[small] = True
    up[by_fill[len(small) : len(small) + fan_in]] = True
    return up


def _placed(rows: pd.DataFrame, bin_of: np.ndarray, base: np.ndarray, fills: np.ndarray, up: np.ndarray, first_id: int, task: int, level: int) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_id": rows["doc_id"], "piece": rows["piece"].astype("int32"), "start": rows["start"], "length": rows["length"], "ids_crc32": rows["ids_crc32"],
        "sequence_id": first_id + bin_of, "offset": base, "task": task, "level": np.where(up[bin_of], level + 1, level).astype("int32"),
    })


def pack_pieces(pieces: DataFrame, width: int = WIDTH, fan_in: int = FAN_IN, pieces_per_task: int = PIECES_PER_TASK, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Give each piece a sequence and its offset there; offsets are gapless from 0.

    Sequence ids hold the level, the task and a running number, and are unique.
    """

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        parts = list(frames)
        if not parts or not sum(map(len, parts)):
            return
        rows = pd.concat(parts, ignore_index=True)
        bin_of, offset, fills = best_fit(rows["length"].to_numpy(), width)
        yield _placed(rows, bin_of, offset, fills, _going_up(fills, width, nearly_full, fan_in), task << 32, task, 0)

    def merged(level: int, last: bool):
        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            task = int(key[0])
            ids, item = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
            sizes = np.bincount(item, weights=rows["length"].to_numpy(), minlength=len(ids)).astype(np.int64)
            bin_of, base, fills = best_fit(sizes, width)
            up = np.zeros(len(fills), bool) if last else _going_up(fills, width, nearly_full, fan_in)
            return _placed(rows, bin_of[item], base[item] + rows["offset"].to_numpy(), fills, up, (level << 56) | (task << 32), task, level)

        return merge

    count = pieces.count()
    tasks = max(1, -(-count // pieces_per_task))
    level = 0
    packed = materialise(pieces.repartition(tasks).mapInPandas(local, PACKED_SCHEMA))
    done = packed.filter("level = 0")
    while True:
        tasks = -(-tasks // fan_in)
        rising = packed.filter(F.col("level") == level + 1).withColumn("task", F.floor(F.col("task") / fan_in))
        level += 1
        merge = rising.groupBy("task").applyInPandas(merged(level, tasks == 1), PACKED_SCHEMA)
        packed = materialise(merge)
        done = done.unionByName(packed.filter(F.col("level") == level))
        if tasks == 1:
            return done.drop("task", "level")


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = WIDTH) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``width`` tokens.

    Returns one row per piece: doc_id, piece (from 0), start (ids of the
    document before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), sequence_id, offset. Only a document longer than
    ``width`` is cut. A null text is empty and gives the separator alone; a null
    doc_id is kept; an empty table gives no rows; other columns are not used.
    """
    return pack_pieces(materialise(tokenised_pieces(docs, tokenizer_path, width)), width)
