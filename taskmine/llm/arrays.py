"""Many texts as one byte array: words, their hashes and hashes of runs of words, without a loop over words.

A word is a maximal run of ASCII digits, ASCII letters (A-Z lower-cased) and bytes of
non-ASCII characters. Hashes are polynomials modulo 2**64 over random byte values, mixed
at the end; they depend on the bytes of the word alone, so they agree between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * U(_ODD))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[9:14] = IS_SPACE[32] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, for n positions at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, _ODD_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def sized(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) whose texts hold about ``limit`` bytes; a longer text is alone."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield at, to
        at = to


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


class Words:
    """Words of packed texts: start and end byte, the text they are in, hash; first[t]:first[t + 1] are those of text t."""

    inside, value = IS_WORD, _VALUE[LOWER]

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n, count = len(data), len(offsets) - 1
        inside = self.inside[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(count), np.diff(self.first))
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * up[:n], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text, in order."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * U(_ODD) + self.hash[k:k + n]
        at = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        return at, mixed(total[at])


class SpacedWords(Words):
    """Words as they stand between ASCII blanks (space, tab to carriage return)."""

    inside, value = ~IS_SPACE, _VALUE

    def joined(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text joined by one space, as packed texts."""
        step = np.zeros(len(self.data) + 1, np.int8)
        step[self.start[kept]] += 1
        step[self.end[kept]] -= 1
        stays = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        out = self.data.copy()
        word = np.flatnonzero(kept)
        gap = self.end[word[:-1][self.text[word[:-1]] == self.text[word[1:]]]]
        stays[gap] = True
        out[gap] = 32
        before = np.concatenate([[0], np.cumsum(stays)])
        return out[stays], before[self.offsets]


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, … inside each of the groups with these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def columns_of(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(name)) for name in names]
