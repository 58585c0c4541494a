"""The xoshiro256** generator, one stream for each row at a time (NumPy, 64-bit wrap-around)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
# Fixed values of the seeding.
_GOLDEN, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


class Streams:
    """Independent generators, seeded element by element."""

    def __init__(self, seeds: np.ndarray) -> None:
        at = np.asarray(seeds, U).copy()
        state = []
        for _ in range(4):
            at = at + _GOLDEN
            z = (at ^ (at >> U(30))) * _M1
            z = (z ^ (z >> U(27))) * _M2
            state.append(z ^ (z >> U(31)))
        state[0] = np.where(state[0] | state[1] | state[2] | state[3] == 0, U(1), state[0])
        self.state = state

    def next(self, only: np.ndarray | None = None) -> np.ndarray:
        """The next number of each stream; streams not in ``only`` stay where they are."""
        s0, s1, s2, s3 = self.state
        five = s1 * U(5)
        out = ((five << U(7)) | (five >> U(57))) * U(9)
        t = s1 << U(17)
        n2, n3 = s2 ^ s0, s3 ^ s1
        n1, n0 = s1 ^ n2, s0 ^ n3
        n2 = n2 ^ t
        n3 = (n3 << U(45)) | (n3 >> U(19))
        new = [n0, n1, n2, n3]
        self.state = new if only is None else [np.where(only, a, b) for a, b in zip(new, self.state, strict=True)]
        return out

    def uniform(self, only: np.ndarray | None = None) -> np.ndarray:
        return (self.next(only) >> U(11)).astype(np.float64) / 9007199254740992.0


def stream(seed: int) -> Iterator[int]:
    """One generator, number by number."""
    one = Streams(np.array([seed % 2**64], U))
    state = [int(s[0]) for s in one.state]
    full = 2**64 - 1
    while True:
        s0, s1, s2, s3 = state
        five = s1 * 5 & full
        yield ((five << 7 | five >> 57) & full) * 9 & full
        t = s1 << 17 & full
        s2 ^= s0
        s3 ^= s1
        s1 ^= s2
        s0 ^= s3
        s2 ^= t
        state = [s0, s1, s2, (s3 << 45 | s3 >> 19) & full]


#: Consecutive items whose numbers are drawn one after the other from a jump to the first.
JUMP_ITEMS = 64


@lru_cache(maxsize=64)
def _leap(k: int) -> np.ndarray:
    """What 2^k steps do to a state of 256 bits, as a matrix over two elements: a step is linear but for its output."""
    if k:
        half = _leap(k - 1).astype(np.float32)
        return (half @ half % 2).astype(np.uint8)  # sums of at most 256 ones
    after = []
    for bit in range(256):
        one = Streams(np.zeros(1, U))
        one.state = [U(1 << (bit % 64)) * np.ones(1, U) if bit // 64 == w else np.zeros(1, U) for w in range(4)]
        one.next()
        after.append(np.unpackbits(np.concatenate(one.state).astype("<u8").view(np.uint8), bitorder="little"))
    return np.array(after)  # row: where a bit of the old state goes


def jumped(seed: int, steps: np.ndarray) -> Streams:
    """For each of ``steps`` (not negative) the generator of ``seed`` after so many numbers: the leaps of its binary digits, one after the other."""
    out = Streams(np.full(len(steps), seed % 2**64, U))
    bits = np.unpackbits(np.stack(out.state, 1).astype("<u8").view(np.uint8).reshape(len(steps), 32), axis=1, bitorder="little")
    left = np.asarray(steps, U).copy()
    for k in range(64):
        goes = (left >> U(k) & U(1)).astype(bool)
        if goes.any():
            bits[goes] = (bits[goes].astype(np.float32) @ _leap(k).astype(np.float32) % 2).astype(np.uint8)
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    out.state = [words[:, w].astype(U) for w in range(4)]
    return out


def drawn(seed: int, items: np.ndarray, each: int) -> np.ndarray:
    """The numbers that one generator draws for ``items`` of a sequence, ``each`` for every item: (items, each), in any order of items.

    Items are taken in runs of ``JUMP_ITEMS``; a run starts where its first item's numbers lie in the one sequence, so that
    tasks need nothing from each other.
    """
    items = np.asarray(items, np.int64)
    run, which = np.unique(items // JUMP_ITEMS, return_inverse=True)
    at = jumped(seed, run * (JUMP_ITEMS * each))
    numbers = np.stack([at.next() for _ in range(JUMP_ITEMS * each)], 1).reshape(len(run), JUMP_ITEMS, each)
    return numbers[which, items % JUMP_ITEMS]
