"""Language of a text: known words by their frequency per language, unseen words by ever shorter character n-grams.

Words are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Training counts words, and the n-grams
of each word with its ends marked, over all labelled texts. Every count is kept in a stored table. The most frequent entries,
``WORD_ENTRIES`` words and ``GRAM_ENTRIES`` n-grams a length at most, are looked up in the task; each other word of a text is valued once
for all texts, by joins with the stored rest, and its value joined to the texts that have it. Heads change the plan and no result.
A word in the word table adds its smoothed log frequency in each language. Any other word adds the mean log frequency of
its n-grams of the longest length at which one is known.

The language with the largest sum wins, ties by name; the score is its share under a uniform prior. Null texts and texts
without a letter are ``und`` with score 0. Rows without a language teach nothing. Without any labelled text all is ``und``.
Columns but those named are ignored, and repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textkit
from corpusloom.llm.scratch import Scratch

UNKNOWN = "und"
WORD_ENTRIES = 1 << 18
GRAM_ENTRIES = 1 << 17
#: Character n-gram lengths, longest first.
LENGTHS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[65:91] = _GAP[97:123] = False
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: A task compacts its counts when it holds so many entries.
_COMPACT = 750_000
#: Bytes of text that are read at a time.
_SLICE_BYTES = 1 << 19


@dataclass
class Model:
    """Sorted hashes and log frequencies by language of the heads; kind 0 has words, kind n has n-grams.

    ``tail(kind, hash, v)`` has the entries that no head has, of the kinds ``tailed``; None if there are none.
    """

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    tail: DataFrame | None = None
    tailed: frozenset[int] = frozenset()


def _parts(batch: pa.RecordBatch) -> Iterator[textkit.Texts]:
    for data, offsets, first in textkit.slices(textkit.text_column(batch), _SLICE_BYTES):
        yield textkit.Texts(data, offsets, first, _GAP)


def _spelled(part: textkit.Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the chosen words in a row, each between two marks (0), and where each begins."""
    lower = np.where((part.data >= 65) & (part.data <= 90), part.data + 32, part.data).astype(np.uint8)
    size = part.ends[words] - part.starts[words] + 1
    begin = np.cumsum(size) - size
    take = np.repeat(part.starts[words] - begin, size) + np.arange(int(size.sum()))
    flat = lower[np.minimum(take, len(lower) - 1)]
    flat[begin + size - 1] = 0
    points = np.frombuffer(b"\0\0\0\0" + flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, np.flatnonzero(points == 0)[:-1]


def _grams(points: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the n-grams; a word shorter than n with its marks has none. Single marks are no 1-gram."""
    size = np.diff(np.append(begins, len(points) - 1)) + 1
    if n == 1:
        at = np.flatnonzero(points != 0)
        word = np.searchsorted(begins, at, "right") - 1
    else:
        many = np.maximum(size - n + 1, 0)
        word = np.repeat(np.arange(len(begins)), many)
        at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + begins[word]
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + points[at + k].astype(np.uint64) + np.uint64(1)
    return word, textkit.mix(h)


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, lang, hash, n) of what a task reads."""
    held: dict[tuple[int, str], list] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (kind, lang), parts in held.items():
            key, n = _sum_up(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], ["kind", "lang", "hash", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        code, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        for part in _parts(batch):
            h = part.hashes(lower=True)
            of = code[part.first + part.doc] if len(h) else np.zeros(0, np.int64)
            for c in np.unique(of):
                mine = np.flatnonzero(of == c)
                key, at, n = np.unique(h[mine], return_index=True, return_counts=True)
                held.setdefault((0, names[c]), []).append((key, n))
                size += len(key)
                points, begins = _spelled(part, mine[at])
                for length in LENGTHS:
                    word, gram = _grams(points, begins, length)
                    held.setdefault((length, names[c]), []).append(_sum_up([(gram, n[word])]))
                    size += len(held[length, names[c]][-1][0])
            if size > _COMPACT:
                for k, parts in held.items():
                    held[k] = [_sum_up(parts)]
                if (size := sum(len(p[0][0]) for p in held.values())) > _COMPACT // 2:
                    yield from out()
                    size = 0
    yield from out()


def _step(n: Column) -> Column:
    """Counts in steps of about 4 %: few enough to be counted on the driver."""
    return F.floor(F.log2(n) * 16).cast("int")


def train(docs: DataFrame) -> Model:
    """Counts over all of ``docs(text, lang)``; the driver gets the bounded heads only."""
    counts = docs.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = counts.mapInArrow(_count, "kind int, lang string, hash long, n long").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))
    by_key = counts.groupBy("kind", "hash").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"), _step(F.sum("n")).alias("step"))
    by_key = Scratch(docs.sparkSession).save(by_key, "language-counts")
    sizes = by_key.select("kind", F.explode("by_lang").alias("lang", "n")).groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    steps = by_key.groupBy("kind", "step").agg(F.count("*").alias("n")).collect()
    langs = sorted({r["lang"] for r in sizes})
    tables, tails, tailed = {}, [], set()
    for kind in (0, *LENGTHS):
        own = {r["lang"]: r for r in sizes if r["kind"] == kind}
        if not own:
            continue
        least, held = None, 0
        for step, n in sorted(((r["step"], r["n"]) for r in steps if r["kind"] == kind), reverse=True):
            held += n
            if held > (GRAM_ENTRIES if kind else WORD_ENTRIES):
                tailed.add(kind)
                break
            least = step
        types = max(r["types"] for r in own.values())
        totals = np.array([own[x]["n"] if x in own else 0 for x in langs], np.float64)
        rows, in_head = by_key.where(F.col("kind") == kind), F.lit(False) if least is None else F.col("step") >= least
        each = [F.coalesce(F.element_at("by_lang", F.lit(x)), F.lit(0)) for x in langs]
        head = rows.where(in_head).select("hash", F.array(*each).alias("n")).toArrow()
        h = head.column("hash").to_numpy().astype(np.int64).view(np.uint64)
        n = np.asarray(head.column("n").combine_chunks().flatten() if head.num_rows else [], np.float64).reshape(-1, len(langs))
        order = np.argsort(h)
        tables[kind] = (h[order], np.log((n[order] + SMOOTHING) / (totals + SMOOTHING * types)).astype(np.float32))
        if kind in tailed:
            v = [F.log((x + SMOOTHING) / float(of + SMOOTHING * types)).cast("float") for x, of in zip(each, totals, strict=True)]
            tails.append(rows.where(~in_head).select("kind", "hash", F.array(*v).alias("v")))
    return Model(langs, tables, reduce(DataFrame.unionByName, tails) if tails else None, frozenset(tailed))


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, place) of hashes in a table."""
    if not len(table[0]):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    return table[0][at] == h, at


def score_slice(model: Model, part: textkit.Texts) -> np.ndarray:
    """Sum of log frequencies per text and language."""
    out = np.zeros((part.rows, len(model.langs)))
    h = part.hashes(lower=True)
    if not len(h):
        return out
    key, first, back = np.unique(h, return_index=True, return_inverse=True)
    values = np.zeros((len(key), len(model.langs)))
    known, at = _find(model.tables[0], key)
    values[known] = model.tables[0][1][at[known]]
    left = np.flatnonzero(~known)
    if len(left):
        points, begins = _spelled(part, first[left])
        open_ = np.ones(len(left), bool)
        for n in LENGTHS:
            word, gram = _grams(points, begins, n)
            hit, at = _find(model.tables[n], gram)
            hit &= open_[word]
            word, at = word[hit], at[hit]
            many = np.bincount(word, minlength=len(left))
            for k in range(len(model.langs)):
                total = np.bincount(word, model.tables[n][1][at, k], len(left))
                values[left[many > 0], k] = (total / np.maximum(many, 1))[many > 0]
            open_ &= many == 0
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(part.doc, values[back, k], part.rows)
    return out


def _letters(part: textkit.Texts) -> np.ndarray:
    """Whether each text has a letter."""
    sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part.data])])
    letters = sums[part.offsets[1:]] > sums[part.offsets[:-1]]
    for i in np.flatnonzero(~letters):
        text = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        letters[i] = any(c.isalpha() for c in text)
    return letters


def _doubles(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    ends = (np.arange(len(values) + 1) * values.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.float64).ravel()))


def _by_head(shared: Broadcast[Model]):
    """(k1, k2, letters, z, tail) of (text, k1, k2): sums of the words that the head knows, the others with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in _parts(batch):
                z = np.zeros((part.rows, len(model.langs)))
                h = part.hashes(lower=True)
                key, back = np.unique(h, return_inverse=True)
                known, at = _find(model.tables[0], key)
                mine = np.flatnonzero(known[back])
                for k in range(len(model.langs)):
                    z[:, k] = np.bincount(part.doc[mine], model.tables[0][1][at[back[mine]], k], part.rows)
                left = np.flatnonzero(~known[back])
                order = left[np.lexsort((h[left], part.doc[left]))]
                new = np.append(True, (h[order][1:] != h[order][:-1]) | (part.doc[order][1:] != part.doc[order][:-1])) if len(order) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                n, first = np.diff(np.append(at, len(order))), order[at]
                size = part.ends[first] - part.starts[first]
                begin = np.cumsum(size) - size
                flat = textkit.lower(part.data[np.repeat(part.starts[first] - begin, size) + np.arange(int(size.sum()))])
                spelled = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(begin, size.sum()).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))
                ends = np.append(0, np.cumsum(np.bincount(part.doc[first], minlength=part.rows))).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n.astype(np.int64)), spelled], ["h", "n", "word"])
                keys = [batch.column(i).slice(part.first, part.rows) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(_letters(part)), _doubles(z), pa.ListArray.from_arrays(pa.array(ends), tail)], ["k1", "k2", "letters", "z", "tail"])

    return run


def _by_grams(shared: Broadcast[Model]):
    """(h, kind, gram, many, z) of words (h, word): per length what the head knows of a word (no gram), and grams to be joined.

    Lengths below one of which the head knows an n-gram are left out: they can't decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            h = batch.column(0).to_numpy()
            for part in _parts(batch):
                own = h[part.first + part.doc]
                points, begins = _spelled(part, np.arange(len(own)))
                open_ = np.ones(len(own), bool)
                for n in LENGTHS:
                    if n not in model.tables:
                        continue
                    word, gram = _grams(points, begins, n)
                    on = open_[word]
                    word, gram = word[on], gram[on]
                    hit, at = _find(model.tables[n], gram)
                    many = np.bincount(word[hit], minlength=len(own))
                    some = np.flatnonzero(many)
                    z = np.stack([np.bincount(word[hit], model.tables[n][1][at[hit], k], len(own))[some] for k in range(len(model.langs))], 1)
                    asked = np.flatnonzero(~hit) if n in model.tailed else np.zeros(0, np.int64)
                    nulls = np.arange(len(some) + len(asked)) < len(some)
                    rows = np.concatenate([own[some], own[word[asked]]])
                    z = np.concatenate([z, np.zeros((len(asked), len(model.langs)))])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows), pa.array(np.full(len(rows), n, np.int32)), pa.array(np.concatenate([np.zeros(len(some), np.int64), gram[asked].view(np.int64)]), mask=nulls),
                        pa.array(np.concatenate([many[some], np.ones(len(asked), np.int64)])), _doubles(z),
                    ], ["h", "kind", "gram", "many", "z"])
                    open_ &= many == 0

    return run


def _sums(rows: DataFrame, langs: int, *by: str, more: str) -> DataFrame:
    """Sums of ``z`` by place and of the column ``more``."""
    summed = rows.groupBy(*by).agg(F.sum(more).alias(more), *(F.sum(F.col("z")[k]).alias(f"z{k}") for k in range(langs)))
    return summed.select(*by, more, F.array(*(f"z{k}" for k in range(langs))).alias("z"))


def _predict_all(docs: DataFrame, model: Model, shared: Broadcast[Model]) -> DataFrame:
    """As ``predict`` for a model with a tail; texts are told apart by 128 bits of hash."""
    scratch, langs = Scratch(docs.sparkSession), len(model.langs)
    text = F.col("text").cast("string")
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    schema = "k1 long, k2 long, letters boolean, z array<double>, tail array<struct<h:long,n:long,word:string>>"
    judged = scratch.save(docs.select(F.coalesce(text, F.lit("")).alias("text"), keys[0].alias("k1"), keys[1].alias("k2")).mapInArrow(_by_head(shared), schema), "judged")
    words = judged.select(F.explode("tail").alias("x")).groupBy("x.h").agg(F.max("x.word").alias("word"))
    met = scratch.save(words.join(model.tail.where("kind = 0").select(F.col("hash").alias("h"), "v"), "h", "left"), "words")
    grams = met.where("v is null").select("h", "word").withColumnRenamed("word", "text")
    grams = scratch.save(grams.mapInArrow(_by_grams(shared), "h long, kind int, gram long, many long, z array<double>"), "grams")
    asked = grams.where("gram is not null").select("h", "kind", F.col("gram").alias("hash"), "many").join(model.tail, ["kind", "hash"])
    by_kind = grams.where("gram is null").drop("gram").unionByName(asked.select("h", "kind", "many", F.col("v").cast("array<double>").alias("z")))
    longest = _sums(by_kind, langs, "h", "kind", more="many").groupBy("h").agg(F.max_by(F.struct("z", "many"), "kind").alias("x"))
    values = longest.select("h", F.transform("x.z", lambda v: v / F.col("x.many")).alias("v"))
    values = scratch.save(values.unionByName(met.where("v is not null").select("h", F.col("v").cast("array<double>").alias("v"))), "values")
    rest = judged.select("k1", "k2", F.explode("tail").alias("x")).select("k1", "k2", F.col("x.h").alias("h"), F.col("x.n").alias("n")).join(values, "h")
    rest = rest.select("k1", "k2", F.lit(0).alias("copies"), F.transform("v", lambda v: v * F.col("n")).alias("z"), F.lit(None).cast("boolean").alias("letters"))
    # Copies of a text all bring the same sums: they are divided by their number.
    both = judged.select("k1", "k2", F.lit(1).alias("copies"), "z", "letters").unionByName(rest)
    both = both.groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), F.bool_or("letters").alias("letters"), *(F.sum(F.col("z")[k]).alias(f"z{k}") for k in range(langs)))
    both = both.select("k1", "k2", "letters", F.array(*(F.col(f"z{k}") / F.col("copies") for k in range(langs))).alias("z")).withColumn("most", F.array_max("z"))
    share = 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("most")))
    names = F.array(*(F.lit(x) for x in model.langs))
    best = both.select(
        F.col("k1").alias("_lang_k1"), F.col("k2").alias("_lang_k2"),
        F.when(F.col("letters"), F.element_at(names, F.array_position("z", F.col("most")).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), share).otherwise(0.0).alias("lang_score"),
    )
    best = scratch.save(best, "best")
    for done in ("judged", "words", "grams", "values"):
        scratch.drop(done)
    return docs.withColumns({"_lang_k1": keys[0], "_lang_k2": keys[1]}).join(best, ["_lang_k1", "_lang_k2"], "left").select(*docs.columns, "lang_pred", "lang_score")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``lang_score``, by its column text. Columns that had these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, tail=None))
    if model.tail is not None:
        return _predict_all(docs, model, shared)
    names = docs.columns
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(text_at)
            preds, scores = [], []
            for part in _parts(batch):
                letters = _letters(part)
                if not model.langs:
                    letters[:] = False
                    best, share = np.zeros(part.rows, np.int64), np.zeros(part.rows)
                else:
                    z = score_slice(model, part)
                    best = z.argmax(1)
                    share = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                preds += [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                scores.append(np.where(letters, share, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], column, *batch.columns[text_at + 1 :], pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names, "lang_pred", "lang_score"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
