"""Byte-level BPE over Arrow batches, with the tokenizers library and any rank file of byte sequences.

The library works on characters, so each byte stands for one printable character. The merges are worked out from the
ranks: every way to split a token in two tokens is a merge, at the token's rank, which is what merging by the rank of the
joined bytes means. A match of the pattern that is a token as it stands is not merged at all.

Offsets count code points of the text. Where several tokens share one character, each has the whole character's span.
Decoding turns ids back to bytes. Tokens may end within a character, so bytes are joined before they are read as UTF-8;
bytes that are no UTF-8 become U+FFFD in the text and stay as they are in the bytes.

A null text is empty: no ids, no offsets. A null list of ids decodes to nothing. Unknown ids raise an error. Special
tokens are neither looked for nor added. Extra columns pass through; repeated rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import textkit

#: A worker holds the ids of up to so many parts.
CACHE = 100_000
#: Rows that are decoded at a time.
ROWS = 512
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 1 << 19
_RUN = re.compile(r"\s[ \n]|^\n")


def byte_characters() -> list[str]:
    """The character of each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def vocabulary(path: str) -> dict[str, int]:
    """The tokens of a rank file as the library spells them, a character for each byte, and their ids."""
    table = byte_characters()
    return {"".join(table[x] for x in b): i for b, i in ranks(path).items()}


@cache
def _pieces(path: str) -> tuple[bytes, np.ndarray]:
    """All tokens' bytes, by the reversed byte table, in a row by id, and where each begins."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    known = {i: bytes(map(byte.__getitem__, characters)) for characters, i in vocabulary(path).items()}
    each = [known.get(i, b"") for i in range(max(known, default=-1) + 1)]
    return b"".join(each), np.concatenate([[0], np.cumsum([len(b) for b in each], dtype=np.int64)])


@cache
def tokenizer(path: str, pattern: str):
    """A tokenizer for the rank file; made once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table, known = byte_characters(), ranks(path)
    shown = {b: "".join(table[x] for x in b) for b in known}
    merges = [(shown[b[:k]], shown[b[k:]]) for b in sorted(known, key=known.get) for k in range(1, len(b)) if b[:k] in known and b[k:] in known]
    out = Tokenizer(models.BPE(vocabulary(path), merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Encoder:
    """Ids of whole texts, with the ids of the parts between white space held for the next time.

    No match of public_tokenizers.PATTERN reaches from another character to white space, and none looks back. So a text can be
    cut before each space or line end that follows no white space, and the ids of its parts are the ids of the text. With
    any other pattern texts are encoded whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.encoder, self.parts = tokenizer(path, pattern), pattern == public_tokenizers.PATTERN
        self.held: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of all parts: held ones, and, once CACHE parts are held, others for this call alone."""
        new = [p for p in parts if p not in self.held]
        texts = [p if p[:1] == "\n" else f" {p}" for p in new]
        found = {p: np.array(e.ids, "<i4").tobytes() for p, e in zip(new, self.encoder.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        if len(self.held) + len(found) <= CACHE:
            self.held |= found
            return self.held
        return found | {p: self.held[p] for p in parts if p in self.held}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [None if not self.parts or _RUN.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        ids = self._learn({p for parts in cut if parts for p in parts[1:]})
        # What has runs of white space is encoded whole, and so is the start of a text, which no space precedes.
        plain = [t if parts is None else parts[0] for t, parts in zip(texts, cut, strict=True)]
        first = [np.array(e.ids, "<i4").tobytes() for e in self.encoder.encode_batch_fast(plain, add_special_tokens=False)]
        return [a if parts is None else a + b"".join(map(ids.__getitem__, parts[1:])) for a, parts in zip(first, cut, strict=True)]


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``docs`` plus ``token_ids`` and, if asked for, ``token_offsets`` (start, end of each id), which replace columns of these names."""
    docs = docs.drop("token_ids", "token_offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = textkit.text_column(batch, text_col).fill_null("")
            for _, bounds, row in textkit.slices(column, SLICE_BYTES):
                rows = len(bounds) - 1
                part = column.slice(row, rows).to_pylist()
                if offsets:
                    found = tokenizer(path, pattern).encode_batch(part, add_special_tokens=False)
                    ids = [np.array(e.ids, np.int32) for e in found]
                else:
                    ids = [np.frombuffer(x, "<i4") for x in _encoder(path, pattern).encode(part)]
                length = np.array([len(x) for x in ids])
                columns = [textkit.list_array(np.concatenate(ids).astype(np.int32), length)]
                if offsets:
                    spans = np.concatenate([np.array(e.offsets, np.int32).reshape(-1, 2) for e in found])
                    span = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), span))
                names = ["token_ids", "token_offsets"][: len(columns)]
                yield pa.RecordBatch.from_arrays([*(c.slice(row, rows) for c in batch.columns), *columns], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    if offsets:
        schema = schema.add("token_offsets", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    return docs.mapInArrow(run, schema)


def _spelled(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ids stand for."""
    data, begins = _pieces(path)
    row = ids.astype(np.int64)
    if len(row) and (row.min() < 0 or row.max() >= len(begins) - 1):
        raise ValueError("an id is not in the vocabulary")
    size = begins[row + 1] - begins[row]
    take = np.repeat(begins[row] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.frombuffer(data, np.uint8)[take].tobytes()


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each list; none of a null."""
    return (np.zeros(0, np.int64) if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in column)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS))


def decode(ids: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``ids`` plus ``decoded_bytes`` and ``decoded_text`` of the lists in ``ids_col``, which replace columns of these names."""
    ids = ids.drop("decoded_bytes", "decoded_text")
    at = ids.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = [_spelled(x, path) for x in _lists(batch.column(at))]
            columns = [pa.array(out, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "decoded_bytes", "decoded_text"])

    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField("decoded_bytes", T.BinaryType()), T.StructField("decoded_text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with, in place of the text, ``n_tokens`` and the digests of its ids and of the bytes that they decode to.

    Encoded and decoded by the same worker, so that a task has one and no list of ids goes back and forth. Columns that
    had these names are replaced.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name not in (text_col, *new)]
    keep = [docs.schema.fields[i] for i in kept]

    def digests(ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(_spelled(ids, path)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = textkit.text_column(batch, text_col).fill_null("")
            for _, bounds, row in textkit.slices(column, SLICE_BYTES):
                rows = len(bounds) - 1
                found = [digests(np.frombuffer(x, "<i4")) for x in _encoder(path, pattern).encode(column.slice(row, rows).to_pylist())]
                columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, rows) for i in kept), *columns], [*(f.name for f in keep), *new])

    return docs.mapInArrow(run, T.StructType([*keep, *map(T.StructField, new, (T.LongType(), T.StringType(), T.StringType()))]))
