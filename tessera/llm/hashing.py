"""Hashes of words, shingles and substrings for a whole batch at once, by prefix sums of a 64-bit polynomial."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > _KEPT:
            return _powers(_BASE, n), _powers(_INVERSE, n)
        if len(self.up) < n:
            size = min(_KEPT, 1 << (n - 1).bit_length())
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up[:n], self.down[:n]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


#: Powers that are kept between batches.
_KEPT = 1 << 21
_POWERS = _Powers()
_VALUES = mix(np.arange(1 << 14, dtype=np.uint64) + np.uint64(1))


class Prefix:
    """Hash of any part of a sequence of symbols (bytes or code points) in constant time, at any place alike."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        power, self.inverse = _POWERS.get(n + 1)
        self.sum = np.zeros(n + 1, dtype=np.uint64)
        known = n == 0 or symbols.dtype == np.uint8 or symbols.max() < len(_VALUES)
        values = _VALUES[symbols] if known else mix(symbols.astype(np.uint64) + np.uint64(1))
        np.cumsum(values * power[:-1], out=self.sum[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """part(i, i + size) at every place i."""
        n = max(0, len(self.sum) - size)
        return mix((self.sum[size:] - self.sum[:n]) * self.inverse[:n] + np.uint64(size))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pa.array(column).cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column])  # offsets from 0
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


#: Bytes of text that are hashed together.
TOGETHER = 1 << 20


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """`_shingle_sets` of the rows, some `TOGETHER` bytes at a time, so that a batch's arrays stay small."""
    column = pa.array(column)
    size = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // TOGETHER
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(size) else np.zeros(1, np.int64)
    return [x for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) for x in _shingle_sets(column.slice(a, b - a), words)]


def _shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's `words`-word shingles (A-Z lower-cased); of the whole sequence as one if
    there are fewer words; none without a word."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    low = _LOWER[raw]
    # A gap at each text's end keeps words apart.
    padded = np.insert(low, offsets[1:], 32) if n else low
    edge = offsets[1:] + np.arange(1, n + 1)
    solid = ~_IS_SPACE[padded]
    step = np.diff(np.r_[False, solid, False].astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    word = Prefix(padded).part(start, end)
    first = np.r_[0, np.searchsorted(start, edge)]
    if len(word) >= words:
        rolled = np.zeros(len(word) - words + 1, dtype=np.uint64)
        for k in range(words):
            rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + word[k : k + len(rolled)] + np.uint64(k + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for w in word[a:b]:
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


class Bloom:
    """A set of 64-bit numbers in a fixed number of bits: never misses one, may pass others."""

    def __init__(self, bits: int = 24) -> None:
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), dtype=np.uint8)

    def _at(self, keys: np.ndarray) -> list[np.ndarray]:
        keys = keys.astype(np.uint64, copy=False)
        return [mix(keys + np.uint64(s)) >> np.uint64(64 - self.bits) for s in (0x51ED, 0xA3C7, 0x77F1)]

    def add(self, keys: np.ndarray) -> None:
        for h in self._at(keys):
            np.bitwise_or.at(self.data, h >> np.uint64(3), np.left_shift(1, h & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for h in self._at(keys):
            out &= (self.data[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out
