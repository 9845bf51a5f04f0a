"""Fill-in-the-middle examples: both cuts of a text are found by rank queries on a wavelet matrix of character classes.

A text is n tokens, each a run of white space with the run of other characters after it, or white space at the end. The
matrix holds one class per byte: a run's first byte or a later one, of white space or of other characters, or a byte
inside a character. Ranks of classes, added up, count boundaries: tokens that end before a place are the starts of white-space
runs up to it, less one that begins the text. The k-th cut is found by bisection on that sum, for all texts of a slice at once;
characters are bytes less those inside characters.

Where the cuts fall, and which form an example gets, follows from a hash of the seed and the id, so a text keeps its
example whatever else the table holds, and a task that runs again writes the same rows.

A null or empty text is left plain and gives the empty example with no tokens. A null id counts as the empty string. Texts that
contain a mark are left plain, so each example can be undone. Rows are independent: repeated rows give equal examples. Columns
with the names of new ones are replaced, all others pass through. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textkit
from corpusloom.llm.wavelet import WaveletMatrix

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut; of a hundred cut ones so many get the suffix first.
CUT_RATE, SUFFIX_FIRST_RATE = 50, 80
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Classes of bytes.
INNER, WORD, SPACE_ON, SPACE, INSIDE = range(5)
CLASS_BITS = 3

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NEW = T.StructType([
    T.StructField("fim_text", T.StringType()), T.StructField("fim_form", T.StringType()), T.StructField("fim_tokens", T.LongType()),
    T.StructField("fim_prefix_chars", T.LongType()), T.StructField("fim_middle_chars", T.LongType()),
])


class Classes:
    """Texts laid end to end, with the classes of their bytes behind a wavelet matrix."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        space = _SPACE[data]
        begins = np.ones(len(data), bool)
        begins[1:] = space[1:] != space[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        kind = np.where(space, np.where(begins, SPACE, SPACE_ON), np.where(begins, WORD, INNER)).astype(np.uint8)
        kind[(data & 0xC0) == 0x80] = INSIDE
        self.matrix, self.first, self.end = WaveletMatrix(kind, CLASS_BITS), offsets[:-1], offsets[1:]
        full = self.end > self.first
        self.led = full.copy()
        self.led[full] = space[self.first[full]]
        trailed = full.copy()
        trailed[full] = space[self.end[full] - 1]
        self.before = self.matrix.rank(SPACE, self.first)
        #: Tokens of each text: its runs of other characters, and white space at its end.
        self.tokens = self.matrix.rank(WORD, self.end) - self.matrix.rank(WORD, self.first) + trailed

    def cuts(self, k: np.ndarray) -> np.ndarray:
        """The place after the k-th token of each text."""
        # The k-th run of other characters ends where white space begins for the k-th time, not counting white space that leads.
        wanted = self.before + k + self.led
        low, high = self.first.copy(), self.end.copy()
        while (low < high).any():
            mid = (low + high) >> 1
            there = self.matrix.rank(SPACE, np.minimum(mid + 1, self.end)) >= wanted
            low, high = np.where(there, low, np.minimum(mid + 1, high)), np.where(there, mid, high)
        return np.where(k == 0, self.first, np.where(k >= self.tokens, self.end, low))

    def chars(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Characters between two places."""
        return right - left - (self.matrix.rank(INSIDE, right) - self.matrix.rank(INSIDE, left))


def draws(ident: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_rate: int = CUT_RATE, suffix_first: int = SUFFIX_FIRST_RATE) -> DataFrame:
    """``docs`` without the text, plus ``fim_text``, ``fim_form`` (plain, psm, spm), ``fim_tokens``, ``fim_prefix_chars``, ``fim_middle_chars``."""
    kept = [c for c in docs.columns if c not in (text_col, *_NEW.names)]
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    drawn = docs.select(*kept, F.col(text_col).cast("string").alias(f"{free}t"), F.array(*draws(F.col(id_col), seed)).alias(f"{free}h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, hashes = textkit.text_column(batch, f"{free}t").fill_null(""), batch.column(batch.num_columns - 1)
            for data, offsets, row in textkit.slices(column):
                rows = len(offsets) - 1
                h = hashes.slice(row, rows).flatten().to_numpy(zero_copy_only=False).reshape(rows, 4)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, rows) for i in range(len(kept))), *_examples(data, offsets, h, cut_rate, suffix_first)], names=[*kept, *_NEW.names])

    return drawn.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *_NEW.fields]))


def _examples(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, cut_rate: int, suffix_first: int) -> list[pa.Array]:
    classes = Classes(data, offsets)
    n, whole, rows = classes.tokens, data.tobytes(), len(offsets) - 1
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    left, right = classes.cuts(np.minimum(one, two)), classes.cuts(np.maximum(one, two))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    cut = (h[:, 2] % 100 < cut_rate) & (n > 0)
    form, out = np.full(rows, PLAIN, object), []
    for i, (a, l, r, e) in enumerate(zip(offsets[:-1].tolist(), left.tolist(), right.tolist(), offsets[1:].tolist(), strict=True)):
        text = whole[a:e]
        if cut[i] and not any(m in text for m in marks):
            p, m, s = whole[a:l], whole[l:r], whole[r:e]
            spm = h[i, 3] % 100 < suffix_first
            form[i] = SPM if spm else PSM
            text = b"".join((marks[1], s, marks[0], p, marks[2], m) if spm else (marks[0], p, marks[1], s, marks[2], m))
        out.append(text)
    plain = form == PLAIN
    before, middle = classes.chars(offsets[:-1], left), classes.chars(left, right)
    return [
        pa.array(out, pa.binary()).cast(pa.string()), pa.array(form, pa.string()), pa.array(n.astype(np.int64)),
        pa.array(before, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain),
    ]


def restored(text: Column, form: Column) -> Column:
    """The text that an example was made of."""
    part = F.split(text, "|".join((PREFIX, SUFFIX, MIDDLE)))
    return F.when(form == PSM, F.concat(part[1], part[3], part[2])).when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(text)
