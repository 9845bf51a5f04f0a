"""Postings and BM25 ranking as joins and sums over terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Characters of texts that are counted together; a longer text is counted by itself.
LETTERS = 1 << 19


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def char_tokens(text: Column) -> Column:
    """All characters but white space, then all pairs of neighbours: for scripts without word marks."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    one = F.regexp_extract_all(bare, F.lit("(?s)."), F.lit(0))
    pairs = F.greatest(F.size(one) - 1, F.lit(0))
    return F.concat(one, F.zip_with(F.slice(one, 1, pairs), F.slice(one, 2, pairs), lambda a, b: F.concat(a, b)))


def postings(docs: DataFrame, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``(doc_id, term, tf)`` of ``docs(doc_id, text)``; counted in each task before the shuffle."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    cells.sort()
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
    return cells[first], np.diff(np.append(first, len(cells)))


def _words_of(points: np.ndarray, width: int) -> pa.Array:
    """Strings of ``width`` code points each."""
    flat = points.reshape(-1)
    size = 1 + (flat >= 0x80).astype(np.int32) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    data = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(flat) // width, pa.py_buffer(np.ascontiguousarray(ends[::width])), pa.py_buffer(data))


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, term, tf)`` of batches ``(doc_id, bare)``: characters and pairs of neighbours of each text, counted by sorts of numbers."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        ends = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + LETTERS, "right")) - 1)
            points = np.frombuffer("".join(texts.slice(start, stop - start).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
            row = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
            # Letters get numbers, so that a text and two letters fit in one.
            known, letter = np.unique(points, return_inverse=True)
            n = max(len(known), 1)
            one, many = _runs(row * n + letter)
            paired = np.flatnonzero(row[1:] == row[:-1])
            two, often = _runs((row[paired] * n + letter[paired]) * n + letter[paired + 1])
            left, last = np.divmod(two, n)
            for at, term, tf in ((one // n, _words_of(known[one % n], 1), many), (left // n, _words_of(np.stack([known[left % n], known[last]], 1), 2), often)):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + at)), term, pa.array(tf, pa.int64())], ["doc_id", "term", "tf"])
            start = stop


def char_postings(docs: DataFrame) -> DataFrame:
    """postings of ``char_tokens``: a text's characters and pairs are counted where it is, so that only distinct ones are shuffled."""
    bare = docs.select("doc_id", F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"(?U)\s+", "").alias("bare"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = bare.mapInArrow(_char_counts, f"doc_id {kind}, term string, tf long")
    return counted.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def lengths(docs: DataFrame, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``(doc_id, dl)`` of all documents, those without tokens too."""
    return docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def corpus_stats(lens: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return lens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(term, df, idf)``. A negative idf becomes EPSILON times the mean idf of the vocabulary, taken before."""
    return inverse_frequencies(posts.groupBy("term").agg(F.count("*").alias("df")), corpus)


def inverse_frequencies(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """term_stats from document frequencies ``(term, df)`` of the whole vocabulary."""
    raw = df.crossJoin(F.broadcast(corpus.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, posts: DataFrame, lens: DataFrame, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """``(query_id, doc_id, score)`` of documents that share a term with ``queries(query_id, text)``; repeated query terms count again."""
    corpus = corpus_stats(lens)
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weighed = asked.join(term_stats(posts, corpus), "term")
    return _scored(posts.join(weighed, "term").join(lens, "doc_id"), corpus)


def bm25_of(queries: DataFrame, docs: DataFrame, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """bm25 over ``docs(doc_id, text)`` without an index: only words that are asked for are grouped by document."""
    cut = docs.select("doc_id", tokens(F.col("text")).alias("tokens"))
    corpus = corpus_stats(cut.select("doc_id", F.size("tokens").cast("long").alias("dl")))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    df = cut.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked.join(inverse_frequencies(df, corpus), "term")
    said = cut.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    return _scored(said.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).join(weighed, "term"), corpus)


def _scored(met: DataFrame, corpus: DataFrame) -> DataFrame:
    met = met.crossJoin(F.broadcast(corpus))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, by: str = "score", ident: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank, ties by id."""
    order = W.partitionBy("query_id").orderBy(F.col(by).desc(), F.col(ident))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def full_ranks(scored: DataFrame, width: float, by: str = "score", ident: str = "doc_id") -> DataFrame:
    """Every row of each query with its rank, ties by id: as ``top`` without a limit, but no task has to sort all rows of a query.

    Rows are ranked within steps of ``width`` of the score; the counts of better steps are added. The width steers cost only.
    """
    stepped = scored.withColumn("_step", F.floor(-F.col(by) / width))
    counts = stepped.groupBy("query_id", "_step").agg(F.count("*").alias("_n"))
    better = F.sum("_n").over(W.partitionBy("query_id").orderBy("_step").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("query_id", "_step", F.coalesce(better, F.lit(0)).alias("_better"))
    within = F.row_number().over(W.partitionBy("query_id", "_step").orderBy(F.col(by).desc(), F.col(ident)))
    return stepped.withColumn("_within", within).join(offsets, ["query_id", "_step"]).withColumn("rank", F.col("_better") + F.col("_within")).drop("_step", "_better", "_within")
