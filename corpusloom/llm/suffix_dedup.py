"""Bytes of passages that occur again anywhere in the corpus, found on Burrows-Wheeler transforms of the places that may repeat.

A place is a start with ``length`` bytes after it in its text. Each place has an anchor: the first of the grams in it with the
least hash, so equal places have equal anchors. Places in a row with one anchor form a segment. An anchor that occurs once has no
repeats; one whose segments are equal throughout has nothing but repeats. The segments of the other anchors, each distinct one
once, are laid out in blocks of whole groups. A block's suffixes are sorted and its transform is stored in a wavelet matrix. Backward
extension, breadth first, begins with the interval of the empty string; each new interval that ends where no common prefix
is known yet fixes it at the present depth. So common prefixes come by increasing value, and after ``length`` steps the borders
that are left part suffixes that agree in ``length`` bytes or more: both begin a repeat.

A group of more than ``GROUP_BYTES`` of distinct segments is dealt out again by longer grams, up to ``length``, so no task
holds a group without bound and no two copies are paired.

Places are judged on the input; overlaps count, and a text's own places too. A null text is empty. Repeated rows are places of
their own, so both lose what they share. Rows are known by the hash of id and text. Other columns pass through; those with the
names of new ones are replaced. An empty table stays empty. Segments are compared by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textkit
from corpusloom.llm.phrase_index import bounded
from corpusloom.llm.scratch import Scratch
from corpusloom.llm.wavelet import WaveletMatrix

LENGTH = 200
#: Distinct segments of one anchor beyond so many bytes are dealt out again; a block has about BLOCK_BYTES.
GROUP_BYTES, BLOCK_BYTES = 2 << 20, 1 << 19
#: Bytes of text whose anchors are looked for together.
SLICE_BYTES = 1 << 18

_MARK = "d long, a int, b int, h long, g long"
_STEP = 1 << 13


def grams(length: int) -> list[int]:
    """Lengths of the grams that places are dealt out by: a third of a place, then ever half as far from the whole."""
    sizes = [max(1, length * 8 // 25)]
    while sizes[-1] < length:
        sizes.append(length - (length - sizes[-1]) // 2)
    return sizes


def anchors(data: np.ndarray, offsets: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, hash of the anchor, hash of the segment) of each segment; starts count from the text's first byte."""
    size, lens = len(data), np.diff(offsets)
    long = lens >= length
    if not long.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(textkit._OF_BYTE[data] * textkit._power(size + 1, textkit._BASE, "up")[:size], out=sums[1:])
    down = textkit._power(size + 1, textkit._INVERSE, "down")
    value = (sums[gram:] - sums[:-gram]) * down[: size - gram + 1]
    width, places = length - gram + 1, size - length + 1
    # The least value of each window of ``width`` grams: runs of that length, least so far from both of their ends.
    rows = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max)
    rows[: len(value)] = value
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:places], ahead[width - 1 : width - 1 + places])
    first, last = offsets[:-1][long], offsets[1:][long] - length
    # A segment ends at its anchor, where a lesser gram comes up, or with its text.
    ends = value[:places] == least
    ends[:-1] |= least[1:] != least[:-1]
    ends[last] = True
    inside = np.zeros(places + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    b = np.flatnonzero(ends & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    text = np.searchsorted(first, b, "right") - 1
    a = np.maximum(np.append(0, b[:-1] + 1), first[text])
    sign = textkit.mix(least[b] ^ np.uint64(gram))
    whole = textkit.mix((sums[b + length] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return np.flatnonzero(long)[text], a - first[text], b - first[text], sign, whole


def repeated_starts(data: np.ndarray, lens: np.ndarray, length: int) -> np.ndarray:
    """Which starts of the segments in ``data``, laid end to end, share ``length`` bytes with another start: one flag per byte."""
    used = np.unique(data)
    ends = np.cumsum(lens + 1) - 1
    text = np.zeros(len(data) + len(lens), np.uint8 if len(used) < 256 else np.uint16)
    real = np.ones(len(text), bool)
    real[ends] = False
    number = np.zeros(256, text.dtype)
    number[used] = np.arange(1, len(used) + 1)
    text[real] = number[data]
    left = np.repeat(ends, lens + 1) - np.arange(len(text))
    order = _sorted_suffixes(text, left, int(lens.max()))
    before = np.where(order > 0, text[order - 1], 0)
    unset = _borders(before, len(lens), len(used).bit_length(), length)
    at = np.flatnonzero(unset) + 1
    at = at[(left[order[at - 1]] >= length) & (left[order[at]] >= length)]
    found = np.zeros(len(text), bool)
    found[order[at - 1]] = found[order[at]] = True
    return found[real]


def _sorted_suffixes(text: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, each up to its segment's end; equal ones by place. Known prefixes double with each turn."""
    key, alive, size = np.zeros(len(text), np.uint64), np.ones(len(text), bool), len(text)
    per = 8 if text.dtype == np.uint8 else 4
    for j in range(per):
        sign = np.zeros(size, np.uint64)
        sign[: size - j] = text[j:]
        alive &= sign > 0
        key = key << np.uint64(64 // per) | np.where(alive, sign, np.uint64(0))
    step = per
    while True:
        order = np.argsort(key, kind="stable")
        of = key[order]
        new = np.ones(size, np.int64)
        new[1:] = of[1:] != of[:-1]
        if step > longest or new.all():
            return order
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(new)
        then = np.zeros(size, np.int64)
        there = np.flatnonzero(left > step)
        then[there] = rank[there + step]
        key, step = rank * (size + 1) + then, 2 * step


def _borders(before: np.ndarray, stops: int, bits: int, length: int) -> np.ndarray:
    """Of the borders between neighbours in order, those with common prefixes of ``length`` or more."""
    size = len(before)
    matrix = WaveletMatrix(before, bits)
    begin = np.zeros((1 << bits) + 1, np.int64)
    np.cumsum(np.bincount(before, minlength=1 << bits), out=begin[1:])
    shift = begin[:-1] - matrix.starts()
    back = np.empty(size, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(size)
    unset = np.ones(size + 1, bool)
    unset[: stops + 1] = unset[size] = False
    low, high = np.zeros(1, np.int64), np.full(1, size, np.int64)
    for _ in range(length):
        # An interval of one suffix extends to one; the others split by the symbols before them.
        one = high - low == 1
        single = low[one]
        single = back[single[before[single] > 0]]
        _, symbol, left, right = matrix.split(low[~one], high[~one])
        real = symbol > 0
        add = shift[symbol[real]]
        low, high = np.concatenate([single, left[real] + add]), np.concatenate([single + 1, right[real] + add])
        new = unset[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        unset[high] = False
    return unset[1:size]


def _marks(texts: DataFrame, gram: int, length: int) -> DataFrame:
    """The segments of ``texts(d, t)``: ``(d, a, b, h, g)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(0).to_numpy()
            for data, offsets, row in textkit.slices(batch.column(1), SLICE_BYTES):
                text, a, b, h, g = anchors(data, offsets, gram, length)
                yield pa.RecordBatch.from_arrays([pa.array(d[row + text]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["d", "a", "b", "h", "g"])

    return texts.mapInArrow(run, _MARK)


def _segments(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """``(s, h, n, t)``: the bytes of the segments ``asked(s, h, n, d, a, b)``."""
    lists = asked.groupBy("d").agg(F.collect_list(F.struct("s", "h", "n", "a", "b")).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole, rows = batch.column(0)[i].as_buffer(), batch.column(1)[i].values
                a, b = (rows.field(c).to_numpy() for c in ("a", "b"))
                cut = [whole.slice(x, y - x) for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.field("s"), rows.field("h"), rows.field("n"), pa.array(map(bytes, cut), pa.binary())], ["s", "h", "n", "t"])

    found = texts.join(bounded(asked.select("d").distinct()), "d", "left_semi").join(lists, "d").select("t", "l")
    return found.mapInArrow(run, "s long, h long, n long, t binary")


def _settled(segments: DataFrame, length: int) -> DataFrame:
    """``(s, x, y)``: runs of starts within a segment that begin repeats. Segments of one anchor come to one task, a block of whole groups at a time."""

    def judged(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(block)
        data, offsets = textkit.raw(rows.column("t").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        lens, s, n = np.diff(offsets), rows.column("s").to_numpy(), rows.column("n").to_numpy()
        found = repeated_starts(data, lens, length)
        row = np.repeat(np.arange(len(lens)), lens)
        at = np.arange(len(data)) - offsets[row]
        found |= (n[row] > 1) & (at + length <= lens[row])
        edge = np.diff(np.concatenate([[0], found.view(np.int8), [0]]))
        x, y = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        return pa.RecordBatch.from_arrays([pa.array(s[row[x]]), pa.array(at[x].astype(np.int32)), pa.array(at[y].astype(np.int32))], ["s", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for whole in batches:
            h = whole.column(1).to_numpy()
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            start = 0
            for end in ends.tolist():
                if size >= BLOCK_BYTES and h[start] != last:
                    yield judged(held)
                    held, size = [], 0
                part = whole.slice(start, end - start)
                held.append(part)
                lens = pa.compute.sum(pa.compute.binary_length(part.column(3))).as_py()
                size, last, start = size + lens, h[start], end
        if held:
            yield judged(held)
        textkit.give_back()

    return segments.repartition("h").sortWithinPartitions("h").mapInArrow(run, "s long, x int, y int")


def repeats(texts: DataFrame, scratch: Scratch, length: int = LENGTH, depth: int = 0) -> DataFrame:
    """``(d, x, y)``: runs of starts in ``texts(d, t binary)`` whose ``length`` bytes start elsewhere too."""
    sizes = grams(length)
    marks = scratch.save(_marks(texts, sizes[depth], length), f"marks{depth}")
    sums = marks.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("n > 1")
    groups = scratch.save(sums.select("h", (F.col("g0") != F.col("g1")).alias("mixed")), f"groups{depth}")
    met = scratch.save(marks.join(bounded(groups), "h").select("d", "a", "b", "h", F.xxhash64("h", "g").alias("s"), "mixed"), f"met{depth}")
    mixed = met.where("mixed")
    asked = mixed.groupBy("s", "h").agg(F.count("*").alias("n"), F.min(F.struct("d", "a", "b")).alias("at"))
    asked = scratch.save(asked.select("s", "h", "n", "at.*"), f"asked{depth}")
    large = scratch.save(asked.groupBy("h").agg(F.sum(F.col("b") - F.col("a") + length).alias("size")).where(F.col("size") > GROUP_BYTES).select("h"), f"large{depth}")
    hot = depth + 1 < len(sizes) and not large.isEmpty()
    small = asked.join(bounded(large), "h", "left_anti") if hot else asked
    verdict = _settled(_segments(texts, small, length), length)
    if hot:
        segments = scratch.save(_segments(texts, asked.join(bounded(large), "h", "left_semi"), length), f"hot{depth}")
        deeper = repeats(segments.select(F.col("s").alias("d"), "t"), scratch, length, depth + 1)
        whole = segments.where("n > 1").select("s", F.lit(0).alias("x"), (F.octet_length("t") - length).cast("int").alias("y"))
        verdict = verdict.unionByName(deeper.select(F.col("d").alias("s"), "x", "y")).unionByName(whole)
    verdict = scratch.save(verdict, f"verdict{depth}")
    runs = mixed.join(bounded(verdict), "s").select("d", (F.col("a") + F.col("x")).alias("x"), (F.col("a") + F.col("y")).alias("y"))
    return met.where("not mixed").select("d", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(runs)


def _spans(runs: DataFrame, length: int) -> DataFrame:
    """``(d, spans)``: per text the maximal runs of covered bytes, as flat pairs of start and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                x, y = (row.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                order = np.argsort(x, kind="stable")
                x, to = x[order], np.maximum.accumulate(y[order] + length)
                new = np.append(True, x[1:] > to[:-1])
                out.append(np.stack([x[new], to[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]], axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["d", "spans"])

    return runs.groupBy("d").agg(F.collect_list(F.struct("x", "y")).alias("l")).mapInArrow(run, "d long, spans array<long>")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without the text, plus ``kept_bytes`` (what is left of its UTF-8), ``n_bytes``, ``n_removed`` and ``n_spans``."""
    new = T.StructType([T.StructField("kept_bytes", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])
    kept = [c for c in docs.columns if c not in (text_col, *new.names)]
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    scratch, body = Scratch(docs.sparkSession), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own: Column = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    runs = repeats(docs.select(own.alias("d"), body.alias("t")), scratch, length)
    spans = scratch.save(_spans(runs, length), "spans").withColumnsRenamed({"d": f"{free}d", "spans": f"{free}spans"})
    joined = docs.select(*kept, body.alias(f"{free}t"), own.alias(f"{free}d")).join(bounded(spans), f"{free}d", "left").select(*kept, f"{free}t", f"{free}spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, size, removed, spans = [], [], [], []
            for text, cut in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                whole = text.as_py()
                pairs = cut.values.to_numpy().reshape(-1, 2).tolist() if cut.is_valid else []
                edges = [0, *(x for p in pairs for x in p), len(whole)]
                left.append(b"".join(whole[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if pairs else whole)
                size.append(len(whole))
                removed.append(len(whole) - len(left[-1]))
                spans.append(len(pairs))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(left, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, removed, spans))], [*kept, *new.names])

    return joined.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *new.fields]))
