"""Rank over small symbols: a wavelet matrix of packed bits, asked for whole arrays of places at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector. ``rank(i)`` is the number of ones before each place of ``i``."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols below ``2 ** bits``, one bit vector for each of their bits, highest first; each is in the order of the bits above."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.size, self.bits, self.levels, self.zeros = len(symbols), bits, [], []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(self.size - int(np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each place of ``i``."""
        at, start = np.asarray(i, np.int64), np.zeros(1, np.int64)
        for b, level, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones, of_start = level.rank(at), level.rank(start)
            at, start = (zeros + ones, zeros + of_start) if symbol >> b & 1 else (at - ones, start - of_start)
        return at - start

    def split(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which, symbol, left, right) of every symbol in every range: its rank before both ends, as places of the last order."""
        which, symbol = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = level.rank(left), level.rank(right)
            none, some = (right - left) > (b - a), b > a
            which = np.concatenate([which[none], which[some]])
            symbol = np.concatenate([symbol[none] << 1, symbol[some] << 1 | 1])
            left, right = np.concatenate([(left - a)[none], zeros + a[some]]), np.concatenate([(right - b)[none], zeros + b[some]])
        return which, symbol, left, right

    def starts(self) -> np.ndarray:
        """Where the last order has the first place of each symbol."""
        at = np.zeros(1 << self.bits, np.int64)
        for b, level, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = level.rank(at)
            at = np.where(np.arange(len(at)) >> b & 1, zeros + ones, at - ones)
        return at
