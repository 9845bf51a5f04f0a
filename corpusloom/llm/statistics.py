"""Counts of each text that quality operators build on, taken from whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import textkit

WINDOW = 8
NAMES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_exclaim", "n_distinct_words", "n_short_words", "n_long_words", "n_bars", "n_marks", "n_capital_words",
]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(bytes(range(48, 58)))
_PUNCT = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_EXCLAIM = _table(b"!")
_BAR = _table(b"|")
_MARK = _table(b"@/_={}[]\\~^")
_NEWLINE = _table(b"\n")
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False


def _repeats(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each (row, hash) occurs twice or more."""
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = np.append(False, same) | np.append(same, False)
    return out


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def measure(part: textkit.Texts) -> dict[str, np.ndarray]:
    """Each of NAMES for the texts of a slice, as 64-bit integers."""
    rows, data, offsets, starts, ends, doc = part.rows, part.data, part.offsets, part.starts, part.ends, part.doc

    def per_text(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CHAR[data], out=chars[1:])
    size = chars[ends] - chars[starts]
    out = {"n_words": part.counts(), "word_chars": np.bincount(doc, size, rows).astype(np.int64), "n_symbols": per_text(_SYMBOL)}

    lines = textkit.Texts(data, offsets, 0, _NEWLINE)
    worded = np.searchsorted(starts, lines.ends) > np.searchsorted(starts, lines.starts)
    of, h = lines.doc[worded], lines.hashes(lower=False)[worded]
    out["n_lines"] = np.bincount(of, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - _distinct(of, h, rows)

    word = part.hashes(lower=False)
    if len(word) >= WINDOW:
        whole = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
        total = np.zeros(len(whole), np.uint64)
        for k in range(WINDOW):
            total = total * np.uint64(0x2545F4914F6CDD1D) + word[whole + k]
        again = whole[_repeats(doc[whole], textkit.mix(total))]
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc, np.cumsum(edge[:-1]) > 0, rows).astype(np.int64)
    else:
        out["n_repeat_words"] = np.zeros(rows, np.int64)
    capital = _UPPER[data[starts]] if len(starts) else np.zeros(0, bool)
    out |= {
        "n_chars": per_text(_CHAR), "n_upper": per_text(_UPPER), "n_digits": per_text(_DIGIT), "n_punct": per_text(_PUNCT), "n_exclaim": per_text(_EXCLAIM),
        "n_distinct_words": _distinct(doc, word, rows), "n_short_words": np.bincount(doc, size <= 3, rows).astype(np.int64), "n_long_words": np.bincount(doc, size >= 12, rows).astype(np.int64),
        "n_bars": per_text(_BAR), "n_marks": per_text(_MARK), "n_capital_words": np.bincount(doc, capital, rows).astype(np.int64),
    }
    return {k: out[k].astype(np.int64) for k in NAMES}


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its column text, plus NAMES as longs. A null or empty text has zeros. Columns that had these names are replaced."""
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name not in ("text", *NAMES)]
    keep = [docs.schema.fields[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, names = [batch.column(i) for i in kept], [batch.schema.names[i] for i in kept]
            for part in textkit.texts(textkit.text_column(batch)):
                found = measure(part)
                yield pa.RecordBatch.from_arrays([*(c.slice(part.first, part.rows) for c in rest), *(pa.array(v) for v in found.values())], [*names, *found])

    return docs.mapInArrow(run, T.StructType([*keep, *(T.StructField(n, T.LongType()) for n in NAMES)]))
