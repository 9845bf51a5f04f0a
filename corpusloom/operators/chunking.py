"""Chunks of documents as character spans: one row in, its chunks out, no shuffle.

Spans are half-open and count code points. An atom is a run of lines that a heading begins or a blank line ends
(``structure``), or each line with text (``line``). The chunks of one document depend on each other, so a small helper walks them
per text inside an Arrow batch; it is linear in the text but for one binary search per chunk. Null and empty texts have none.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
HEADING = r"^(?:#{1,6}\s|[一二三四五六七八九十百]+、)"
BOUNDARY = "。！？；\n"


def atoms(text: str, mode: str = "structure", heading: str = HEADING) -> list[tuple[int, int]]:
    """The atoms of one text."""
    out: list[tuple[int, int]] = []
    fresh = True
    for m in re.finditer(r"[^\n]+", text):
        bare = m[0].strip()
        apart = mode == "line" or re.match(heading, bare) is not None
        # An empty line between this one and the last shows as a gap of more than one character.
        gap = bool(out) and m.start() - out[-1][1] > 1
        if not bare:
            fresh = True
        elif fresh or apart or gap:
            out.append(m.span())
            fresh = False
        else:
            out[-1] = (out[-1][0], m.end())
    return out


def merged(spans: list[tuple[int, int]], target: int, overlap: int) -> list[tuple[int, int]]:
    """Atoms packed to at most ``target`` characters; the next chunk begins at the last atom at least ``overlap`` before the end of this one."""
    if not spans:
        return []
    starts, ends = np.array(spans).T
    out, i = [], 0
    while True:
        last = max(i, int(np.searchsorted(ends, starts[i] + target, "right")) - 1)
        out.append((int(starts[i]), int(ends[last])))
        if last + 1 >= len(starts):
            return out
        back = int(np.searchsorted(starts, ends[last] - overlap, "right")) - 1
        i = max(min(back, last), i + 1) if overlap else last + 1


def _cuts(text: str, marks: str) -> np.ndarray:
    return np.array([m.end() for m in re.finditer(f"[{re.escape(marks)}]", text)], np.int64)


def split_long(text: str, spans: list[tuple[int, int]], most: int, marks: str = BOUNDARY) -> list[tuple[int, int]]:
    """Spans over ``most`` characters cut after the last boundary that fits, else at the limit."""
    cuts, out = _cuts(text, marks), []
    for start, end in spans:
        while end - start > most:
            k = int(np.searchsorted(cuts, start + most, "right")) - 1
            stop = int(cuts[k]) if k >= 0 and cuts[k] > start else start + most
            out.append((start, stop))
            start = stop
        out.append((start, end))
    return out


def windows(text: str, target: int, overlap: int, marks: str = BOUNDARY) -> list[tuple[int, int]]:
    """Windows of at most ``target`` characters with exact overlap, ended at a boundary in their second half if there is one.

    An overlap as long as a window would never end; each window therefore begins at least one character later.
    """
    cuts, out, start, n = _cuts(text, marks), [], 0, len(text)
    while start < n:
        end = min(start + target, n)
        if end < n:
            k = int(np.searchsorted(cuts, end, "right")) - 1
            if k >= 0 and cuts[k] - start >= max(1, target // 2):
                end = int(cuts[k])
        out.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def _listed(parts: Iterator[pa.Array], rule: Callable[[str], list[tuple[int, int]]]) -> Iterator[pa.Array]:
    """Spans of each text as lists of structs; only one text and the plain numbers of a batch are held."""
    for texts in parts:
        flat, ends = array("i"), array("i", [0])
        for text in texts:
            for span in rule(t) if (t := text.as_py()) else ():
                flat.extend(span)
            ends.append(len(flat) // 2)
        start, end = np.frombuffer(flat, np.int32).reshape(-1, 2).T if flat else np.zeros((2, 0), np.int32)
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
        yield pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), spans)


def _spans(rule: Callable[[str], list[tuple[int, int]]]) -> Callable[[Column], Column]:
    @F.arrow_udf(SPANS)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _listed(parts, rule)

    return run


def strategies(mode: str = "structure", heading: str = HEADING) -> dict[str, Callable[[Column], Column]]:
    """Named ways to cut: column of texts to column of spans."""

    def merge(target: int, share: float) -> Callable[[Column], Column]:
        return _spans(lambda t: merged(atoms(t, mode, heading), target, int(target * share)))

    return {
        "full_doc": _spans(lambda t: [(0, len(t))]), "merge_400_o20": merge(400, 0.20), "merge_400_o10": merge(400, 0.10),
        "merge_300_o20": merge(300, 0.20), "merge_500_o20": merge(500, 0.20), "merge_400": merge(400, 0.0),
    }


def structure(most: int, mode: str = "structure", heading: str = HEADING) -> Callable[[Column], Column]:
    """Atoms, the long ones cut."""
    return _spans(lambda t: split_long(t, atoms(t, mode, heading), most))


def window(target: int, share: float, marks: str = BOUNDARY) -> Callable[[Column], Column]:
    """Character windows."""
    return _spans(lambda t: windows(t, target, int(target * share), marks))


def atom_spans(mode: str = "structure", heading: str = HEADING) -> Callable[[Column], Column]:
    """The atoms themselves."""
    return _spans(lambda t: atoms(t, mode, heading))


def chunks(docs: DataFrame, cut: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """``docs`` less its text, plus chunk (from 0 in a document), start, end and chunk_text."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.col(text).alias("_text"), F.posexplode(cut(F.col(text))).alias("chunk", "_span"))
    start, end = F.col("_span.start"), F.col("_span.end")
    return rows.select(*keep, "chunk", start.alias("start"), end.alias("end"), F.substring(F.col("_text"), start + 1, end - start).alias("chunk_text"))
