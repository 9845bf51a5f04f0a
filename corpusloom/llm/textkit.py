"""Whole Arrow batches of texts as byte arrays: word spans and 64-bit hashes without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Slices of a batch hold about so many bytes of text (one longer text is a slice of its own).
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OF_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z mapped to a-z."""
    return _LOWER[data]


def _power(n: int, of: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(1 << (n - 1).bit_length(), of, np.uint64)
        step[0] = 1
        _powers[name] = have = np.cumprod(step, dtype=np.uint64)
    return have


class Texts:
    """A slice of a text column: ``data`` has its bytes, ``starts`` / ``ends`` / ``doc`` its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, spaces: np.ndarray = _SPACE) -> None:
        self.data, self.offsets, self.first, self.rows = data, offsets, first, len(offsets) - 1
        word = ~spaces[data]
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, word
        before[offsets[:-1]] = False
        after = np.empty(len(data) + 1, bool)
        after[-1], after[:-1] = False, word
        after[offsets[1:]] = False
        self.starts = np.flatnonzero(word & ~before[:-1])
        self.ends = np.flatnonzero(word & ~after[1:]) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1

    def hashes(self, lower: bool) -> np.ndarray:
        """One 64-bit hash per word; ``lower`` maps A-Z to a-z first."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        values = _OF_BYTE[_LOWER[self.data] if lower else self.data]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(n + 1, _BASE, "up")[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _power(n + 1, _INVERSE, "down")[self.starts])

    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.bincount(self.doc, minlength=self.rows)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Hand freed memory to the system after a batch: a worker stays for many tasks, and others stand beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) of runs of whole texts of about ``most`` bytes."""
    if not len(column):
        return
    data, offsets = raw(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, min(int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1, row + 60_000, rows))
        yield data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], row
        row = to
    give_back()


def texts(column: pa.Array) -> Iterator[Texts]:
    """The slices of a text column with their words, in row order."""
    for data, offsets, first in slices(column):
        yield Texts(data, offsets, first)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A batch's column of texts as strings."""
    column = batch.column(batch.schema.get_field_index(name))
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column from its flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
