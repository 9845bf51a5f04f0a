"""Phrases of words that keep company, from one count of longest windows per language.

A text is cut at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and those at spaces and tabs into words, A-Z lower-cased. Every word begins a
window: itself and the words that follow it in its piece, ``longest`` in all, padded where the piece ends. Only these longest
windows are counted. A phrase occurs as often as windows begin with it, so ROLLUP over the columns of a window adds
up all shorter phrases, and no shorter n-gram is ever taken out of a text.

A phrase that occurs ``least`` times has only words that do. So words are counted first, and a rarer word ends a
window like the end of a piece: exact for every count that is used. The 2 ** (60 // longest) - 1 most frequent words get numbers,
and a window of them is one long. Windows with any other word carry the 64-bit hashes of their words; a bit table of fixed
size tells most rarer words apart from those, and what it lets through is dropped when it has no name. Both bounds steer cost only.

A null text has no words; a null language is ``und``. Ties are ranked by count, then by phrase in byte order. Columns other than
text and language are ignored; repeated rows count again. Empty tables give no rows. Words of one language with the same
64-bit hash would count as one (a chance of V * V / 2 ** 65 among V words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.llm import textkit
from corpusloom.llm.scratch import Scratch

LONGEST, LEAST, TOP = 3, 10, 2000
#: A shorter phrase goes if a longer one with it has this share of its count, in hundredths.
COVER = 50
UNKNOWN = "und"
#: Bits of the table of words that have no number.
FILTER_BITS = 26
#: Words and windows of so many bytes of text are summed before they leave a worker.
SUM_BYTES = 8 << 20

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _CUT.copy()
_GAP[[32, 9]] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _slim(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    return docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("salt"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[textkit.Texts, np.ndarray]]:
    """Slices of a batch's texts and a 64-bit key for each word and its language."""
    salt = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
    for data, offsets, first in textkit.slices(textkit.text_column(batch)):
        texts = textkit.Texts(data, offsets, first, _GAP)
        yield texts, textkit.mix(texts.hashes(True) ^ salt[first + texts.doc])


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, word, key, n)``: every word of every language, with the key that windows know it by."""

    def summed(held: list) -> pa.RecordBatch:
        keys, n, spelled, langs = (np.concatenate([x[i] for x in held]) for i in range(4))
        found, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        words = pa.array(spelled[first], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(langs[first], pa.string()), words, pa.array(found.view(np.int64)), pa.array(np.bincount(inverse, n).astype(np.int64))], ["lang", "word", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            langs = batch.column(1).to_numpy(zero_copy_only=False)
            for texts, keys in _texts(batch):
                found, at, n = np.unique(keys, return_index=True, return_counts=True)
                spelled = np.empty(len(at), object)
                spelled[:] = [texts.data[a:b].tobytes().translate(_LOWER) for a, b in zip(texts.starts[at].tolist(), texts.ends[at].tolist(), strict=True)]
                held.append((found, n, spelled, langs[texts.first + texts.doc[at]]))
                size += len(texts.data)
                if size >= SUM_BYTES:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    counted = _slim(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, key long, n long")
    return counted.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


@dataclass
class Book:
    """What tasks know of words that are frequent enough: sorted keys of the numbered ones, and a bit table of the keys of the others."""

    keys: np.ndarray
    bits: int
    table: np.ndarray | None

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """A word's number from 1, its key with the top bit set if it may be a word without number, or 0."""
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.where(known, at + 1, 0).astype(np.int64)
        if self.table is not None:
            cell = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            may = ~known & (self.table[cell >> 3] >> (cell & 7) & 1).astype(bool)
            out[may] = (keys[may] | np.uint64(1 << 63)).view(np.int64)
        return out


def book(words: DataFrame, longest: int = LONGEST, most: int | None = None) -> Book:
    """The book of stored ``words(key, n)``: at most ``most`` numbered ones, the most frequent; a bit table of fixed size if there are more."""
    bits = 60 // longest
    most = min(most or 1 << 60, (1 << bits) - 1)
    # Steps of an eighth of a doubling: few rows, whatever the counts are.
    step = F.floor(F.log2("n") * 8)
    cut, room = 0, most
    for row in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            cut = row["step"] + 1
            break
    head = words.where(step >= cut).select("key").toArrow().column(0).to_numpy().view(np.uint64)
    table = None
    if room < 0:
        cell = F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1
        cells = words.where(step < cut).select(F.bitmap_bucket_number(cell).alias("bucket"), F.bitmap_bit_position(cell).alias("bit"))
        table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for row in cells.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
            # Bucket 1 has values from 1 on, at bit 0.
            begin = (row["bucket"] - 1) << 12
            table[begin : begin + 4096] = np.frombuffer(bytes(row["map"]), np.uint8)
    return Book(np.sort(head), bits, table)


def windows(docs: DataFrame, known: Book, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(w0, w1, .., n)``: each longest window, padded with 0, and how often it occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    far = known.table is not None

    def summed(held: list) -> pa.RecordBatch:
        """Windows of numbered words as one long; of the others as they are."""
        w = np.concatenate(held)
        short = w.min(axis=1) >= 0
        packed = np.zeros(int(short.sum()), np.int64)
        for j in range(longest):
            packed = packed << shared.value.bits | w[short, j]
        packed, n = np.unique(packed, return_counts=True)
        rest = w[~short]
        columns = [pa.array(np.append(packed, np.full(len(rest), -1, np.int64))), pa.array(np.append(n, np.ones(len(rest), np.int64)).astype(np.int64))]
        if far:
            at = np.append(np.zeros(len(packed), np.int32), np.arange(len(rest) + 1, dtype=np.int32) * longest)
            columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(rest.reshape(-1)), mask=pa.array(np.arange(len(at) - 1) < len(packed))))
        return pa.RecordBatch.from_arrays(columns, ["k", "n", "far"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for texts, keys in _texts(batch):
                code, pieces = shared.value.codes(keys), np.cumsum(_CUT[texts.data])[texts.starts] if len(keys) else np.zeros(0, np.int64)
                joined = np.zeros(len(code), bool)
                joined[:-1] = (pieces[1:] == pieces[:-1]) & (texts.doc[1:] == texts.doc[:-1])
                lead = [code]
                for _ in range(longest - 1):
                    # The column so far, moved up by one word; it ends where it has ended or a piece does.
                    follows = np.append(lead[-1][1:], 0)
                    lead.append(np.where(joined & (code != 0), follows, 0))
                held.append(np.stack(lead, axis=1)[code != 0])
                size += len(texts.data)
                if size >= SUM_BYTES:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    made = _slim(docs, text_col, lang_col).mapInArrow(run, "k long, n long" + ", far array<long>" * far)
    counted = made.groupBy("k", *["far"] * far).agg(F.sum("n").alias("n"))

    def word(j: int) -> Column:
        near = F.shiftright("k", known.bits * (longest - 1 - j)).bitwiseAND((1 << known.bits) - 1)
        return (F.when(F.col("k") < 0, F.col("far")[j]).otherwise(near) if far else near).alias(f"w{j}")

    return counted.select(*map(word, range(longest)), "n")


def phrase_counts(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """``(p array<long>, n)`` of all phrases in ``counted(w0, w1, .., n)`` that occur ``least`` times: longest windows, and ROLLUP for their beginnings."""
    names = [c for c in counted.columns if c != "n"]
    longest = len(names)
    # One condition, on the sum too, so that it isn't pushed below the exchange: both parts then read the same one.
    whole = counted.where(F.when(F.col(names[-1]) != 0, F.col("n")) >= least).select(F.array(*names).alias("p"), "n")
    if longest == 1:
        return whole
    sums = counted.rollup(*names[:-1]).agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    # Of m columns, the level that keeps the first j has the grouping number 2 ** (m - j) - 1.
    parts = [F.when(F.col("g") == (1 << (longest - 1 - j)) - 1, F.array(*names[:j])) for j in range(1, longest)]
    shorter = sums.where(F.col("n") >= least).select(F.coalesce(*parts).alias("p"), "n").where("p is not null and element_at(p, -1) <> 0")
    return whole.unionByName(shorter)


def scored(counts: DataFrame) -> DataFrame:
    """``(p, a, l, r, score)`` of phrases of two words or more, cut where they hold together least.

    The numbers are decimals of 38 digits on the way: exact for counts below 10 ** 13.
    """
    longer = counts.where(F.size("p") > 1).select("p", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    longer = longer.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("rest"))
    first, rest = counts.select(F.col("p").alias("first"), F.col("n").alias("l")), counts.select(F.col("p").alias("rest"), F.col("n").alias("r"))
    a, left, right = (F.col(c).cast("decimal(13,0)") for c in "alr")
    met = longer.join(first, "first").join(rest, "rest").withColumns({"sa": a, "sl": left, "sr": right})
    cut = met.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * (sa * sa) div (sl * sr)"))
    return cut.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("p", "a", "c.l", "c.r", "c.score")


def uncovered(found: DataFrame, cover: int = COVER) -> DataFrame:
    """``found(p, a)`` without phrases inside a longer one of at least ``cover`` hundredths of their count."""
    inner = "flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n))))"
    inside = found.where(F.size("p") > 2).select(F.explode(F.expr(inner)).alias("p"), F.col("a").alias("most")).groupBy("p").agg(F.max("most").alias("most"))
    return found.join(inside, "p", "left").where(f"most is null or 100 * most < {cover} * a").drop("most")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER, text_col: str = "text", lang_col: str = "lang", numbered: int | None = None) -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(count_words(docs, text_col, lang_col), "words")
    frequent = words.where(F.col("n") >= least)
    known = book(frequent, longest, numbered)
    counts = scratch.save(phrase_counts(windows(docs, known, longest, text_col, lang_col), least), "phrases")
    found = scratch.save(uncovered(scored(counts), cover), "scored")
    spelled = found.select("p", "a", "l", "r", "score", F.posexplode("p").alias("at", "code")).join(_names(frequent, known), "code")
    phrases = spelled.groupBy("p", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _names(words: DataFrame, known: Book) -> DataFrame:
    """``(code, lang, word)`` of the words of a book."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = shared.value.codes(batch.column(2).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column(0), batch.column(1)], ["code", "lang", "word"])

    return words.select("lang", "word", "key").mapInArrow(run, "code long, lang string, word string")
