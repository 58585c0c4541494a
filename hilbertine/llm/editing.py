"""Edit similarity of many pairs of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters that the arrays of one batch of pairs hold.
BATCH_CHARS = 1 << 17
#: Texts up to this length are compared side by side; of longer ones, whole columns are numbers anyway.
SIDE_BY_SIDE = 1024


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points of each text in a row of ``width``, filled up."""
    out = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), width).copy()
    out[np.arange(width) >= np.array([len(t) for t in texts])[:, None]] = fill
    return out


def _alike_from_start(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters each pair begins with alike."""
    width = max(1, max(map(len, a)), max(map(len, b)))
    differ = _codes(a, width, 0xFFFFFFFF) != _codes(b, width, 0xFFFFFFFE)
    first = differ.argmax(1)
    return np.where(differ.any(1), first, width)


def _shifted(x: np.ndarray, low: int) -> np.ndarray:
    """Columns of 64-bit words as one number each, shifted up by a bit; ``low`` enters."""
    out = x << np.uint64(1)
    out[1:] |= x[:-1] >> np.uint64(63)
    out[0] |= np.uint64(low)
    return out


def _sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of columns of 64-bit words as one number each."""
    out = x + y
    over = out < x
    for w in range(1, len(x)):
        out[w] += over[w - 1]
        over[w] |= over[w - 1] & (out[w] == 0)
    return out


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``; no text is empty.

    A column of the table of distances is kept as the bits of its rises and
    falls, for all pairs side by side; pairs that can't come within leave on the way.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    p, t = _codes(a, 64 * int(-(-la.max() // 64)), 0xFFFFFFFF), _codes(b, int(lb.max()), 0xFFFFFFFE)
    kinds, t = np.unique(t, return_inverse=True)
    t = t.reshape(len(b), -1)
    # where each kind of character stands in the first text, as bits: (kind, word, pair)
    places = np.stack([np.ascontiguousarray(np.packbits(p == k, axis=1, bitorder="little").view("<u8").T) for k in kinds])
    out = np.zeros(len(a), bool)
    at = np.arange(len(a))
    word, bit = (la - 1) // 64, ((la - 1) % 64).astype(np.uint64)
    up, down = np.full(places.shape[1:], ~np.uint64(0)), np.zeros(places.shape[1:], np.uint64)
    score, one = la.copy(), np.uint64(1)
    for j in range(t.shape[1]):
        same = places[t[:, j], :, at].T
        either = same | down
        cross = (_sum(same & up, up) ^ up) | same
        rise, fall = down | ~(cross | up), up & cross
        here = np.arange(len(at))
        score = score + ((rise[word, here] >> bit) & one).astype(np.int64) - ((fall[word, here] >> bit) & one).astype(np.int64)
        done = lb == j + 1
        out[at[done]] = score[done] <= most[done]
        rise = _shifted(rise, 1)
        up, down = _shifted(fall, 0) | ~(either | rise), rise & either
        if j % 16 == 15 or j + 1 == t.shape[1]:
            stay = (lb > j + 1) & (score - (lb - j - 1) <= most)
            if not stay.any():
                break
            if stay.sum() < 0.8 * len(stay):
                t, at, la, lb, word, bit, score, most = (x[stay] for x in (t, at, la, lb, word, bit, score, most))
                up, down = np.ascontiguousarray(up[:, stay]), np.ascontiguousarray(down[:, stay])
    return out


def is_within(a: Sequence, b: Sequence, most: int) -> bool:
    """``within`` for one pair of texts or lists of words, a column's rises and falls as two long numbers."""
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = where.get(c, 0)
        cross = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(cross | up)), up & cross
        score += bool(rise & last) - bool(fall & last)
        if score - left > most:
            return False
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(same | down | rise)), rise & (same | down)
    return score <= most


def differ_in_place(a: str, b: str) -> int:
    """A bound of the edit distance: the longer word of each pair in the same place that differs, if there are as many words."""
    u, v = a.split(" "), b.split(" ")
    if len(u) != len(v):
        return max(len(a), len(b))
    return sum(max(len(p), len(q)) for p, q in zip(u, v, strict=True) if p != q)


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices in order of size, in batches whose arrays stay small."""
    order = np.argsort(sizes, kind="stable")
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * (int(sizes[order[last]]) + 1) <= BATCH_CHARS:
            last = min(len(order), last + max(1, (last - first) // 2))
        yield order[first:last]
        first = last


def similar(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """Whether the edit distance of each pair is at most 1 - ``similarity`` of its longer text.

    Two empty texts are similar. What a pair begins and ends with alike is
    left out, and so are pairs that the rest's length decides.
    """
    out = np.zeros(len(a), bool)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    longer = np.maximum(la, lb)
    most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)
    todo = np.flatnonzero(np.abs(la - lb) <= most)
    for part in _batches(longer[todo]):
        rows = todo[part]
        x, y = [a[i] for i in rows], [b[i] for i in rows]
        shorter = np.minimum(la[rows], lb[rows])
        head = np.minimum(_alike_from_start(x, y), shorter)
        tail = np.minimum(_alike_from_start([s[::-1] for s in x], [s[::-1] for s in y]), shorter - head)
        x = [s[h : len(s) - t] for s, h, t in zip(x, head.tolist(), tail.tolist(), strict=True)]
        y = [s[h : len(s) - t] for s, h, t in zip(y, head.tolist(), tail.tolist(), strict=True)]
        rest = longer[rows] - head - tail
        out[rows] = rest <= most[rows]
        open_ = np.flatnonzero((rest > most[rows]) & (shorter > head + tail))
        by_words = np.array([differ_in_place(x[i], y[i]) <= most[rows[i]] for i in open_], bool)
        out[rows[open_[by_words]]] = True
        open_ = open_[~by_words]
        for i in open_[rest[open_] > SIDE_BY_SIDE]:
            k = int(most[rows[i]])
            u, v = x[i].split(" "), y[i].split(" ")
            # so many words changed can't make more edits than that
            out[rows[i]] = is_within(u, v, k // (1 + max(map(len, u + v)))) or is_within(x[i], y[i], k)
        open_ = open_[rest[open_] <= SIDE_BY_SIDE]
        for some in _batches(rest[open_]):
            i = open_[some]
            out[rows[i]] = within([x[k] for k in i], [y[k] for k in i], most[rows[i]])
    return out
