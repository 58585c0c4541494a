"""Vectorised word and shingle hashing over Arrow batches of UTF-8 text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Rows are worked on in runs of about this many bytes, so that temporary arrays stay small.
RUN_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_POSITION = [int(x) | 1 for x in _rng.integers(1, 2**63, 64, dtype=np.int64)]
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def byte_class(members: str) -> np.ndarray:
    """Table of the ASCII bytes in ``members`` and of every byte of a longer character."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in members]] = True
    table[128:] = True
    return table


#: Everything but the white space of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; one-to-one on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for consecutive runs of rows; a null text is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, start and end (bytes) of each maximal run of ``members``; none spans two rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = np.frombuffer(data.tobytes().translate(members.astype(np.uint8).tobytes()), bool)
    edges = np.flatnonzero(inside[1:] ^ inside[:-1])  # a word begins, ends, begins ...
    start, end = edges[::2], edges[1::2]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    split = np.unique(cut[inside[cut] & inside[cut + 1]])
    if len(split):
        start, end = np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets))), start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased, mixed from eight bytes at a time."""
    if not len(start):
        return np.zeros(0, U64)
    low = data.tobytes().translate(LOWER) + bytes(8)
    eight = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    size = end - start
    h = mix((eight[start] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        rest = eight[start[more] + done] & _FIRST_BYTES[np.minimum(size[more] - done, 8)]
        h[more] = mix((h[more] ^ U64(done)) * U64(0xD6E8FEB86659FD93) + rest)
        done += 8
        more = more[size[more] > done]
    return h


def shingle_hashes(row: np.ndarray, h: np.ndarray, n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and hash of each shingle of ``n`` words, in order.

    A row of fewer words, but not none, has its whole sequence as its only shingle.
    """
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out_row, out = [], []
    m = len(h) - n + 1
    if m > 0:
        total = h[:m] * U64(_POSITION[0])
        for k in range(1, n):
            total += h[k : k + m] * U64(_POSITION[k])
        whole = row[:m] == row[n - 1 :]
        out_row.append(row[:m][whole])
        out.append(mix(total[whole]))
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    for size in range(1, n):
        few = np.flatnonzero(count == size)
        if len(few):
            total = np.full(len(few), U64(size) * U64(_POSITION[63]), U64)
            for k in range(size):
                total += h[first[few] + k] * U64(_POSITION[k])
            out_row.append(few)
            out.append(mix(total))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    r, s = np.concatenate(out_row), np.concatenate(out)
    order = np.argsort(r, kind="stable")
    return r[order], s[order]


def shingle_sets(texts: pa.Array, n: int, members: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text, in order."""
    for first, data, offsets in runs(texts):
        size = len(offsets) - 1
        row, start, end = words(data, offsets, members)
        r, s = shingle_hashes(row, word_hashes(data, start, end), n, size)
        cuts = np.searchsorted(r, np.arange(size + 1))
        for i in range(size):
            yield first + i, np.unique(s[cuts[i] : cuts[i + 1]])
