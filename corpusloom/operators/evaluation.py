"""Retrieval and answer evaluation: gold spans, relevance by overlap, ranked metrics, verdict rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corpusloom.functions.text import overlap_share

TOP = (1, 3, 5)
LEAST_OVERLAP = 0.5


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def places(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """All places, overlapping ones too, where a passage begins in a text."""
    for texts, passages in parts:
        out = []
        for text, passage in zip(texts, passages, strict=True):
            found, at = [], text.find(passage) if text and passage else -1
            while at >= 0:
                found.append(at)
                at = text.find(passage, at + 1)
            out.append(found)
        yield pd.Series(out)


def gold_spans(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, passage_id, doc_id, gs, ge)`` of ``passages(query_id, passage_id, doc_id, passage)`` in their documents."""
    met = passages.join(docs.select("doc_id", "text"), "doc_id")
    rows = met.select("query_id", "passage_id", "doc_id", F.char_length("passage").alias("m"), F.explode(places(F.col("text"), F.col("passage"))).alias("gs"))
    return rows.select("query_id", "passage_id", "doc_id", "gs", (F.col("gs") + F.col("m")).alias("ge"))


def relevant(chunks: DataFrame, spans: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """``(query_id, doc_id, chunk)`` where a chunk covers enough of one of the query's spans. The join is by document, then by range."""
    met = chunks.join(spans, "doc_id").where((F.col("start") < F.col("ge")) & (F.col("gs") < F.col("end")))
    return met.where(overlap_share(F.col("start"), F.col("end"), F.col("gs"), F.col("ge")) >= least).select("query_id", "doc_id", "chunk").distinct()


def metrics(ranked: DataFrame, relevance: DataFrame, queries: DataFrame, keys: Sequence[str], top: Sequence[int] = TOP, by: Sequence[str] = ()) -> DataFrame:
    """Hit, MRR, precision and recall at each k of ``ranked(query_id, rank, *keys)`` against ``relevance(query_id, *keys)``.

    All are means over ``queries(query_id)``, recall over those with something relevant. Precision divides by k, whatever was found.
    ``by`` are columns of all three inputs that are reported apart.
    """
    return means(per_query(ranked, relevance, queries, keys, top, by).groupBy(*by, "k"))


def per_query(ranked: DataFrame, relevance: DataFrame, queries: DataFrame, keys: Sequence[str], top: Sequence[int] = TOP, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, query_id, k, hits, first, total)``: relevant rows up to rank k, the first one's rank, and all there are (null without any)."""
    by = list(by)
    held = [c for c in by if c in relevance.columns]
    total = relevance.groupBy(*held, "query_id").agg(F.count("*").alias("total"))
    found = ranked.join(relevance, [*held, "query_id", *keys], "left_semi").select(*by, "query_id", "rank")
    ks = queries.select(*by, "query_id", F.explode(F.array(*map(F.lit, top))).alias("k"))
    per = ks.join(found, [*by, "query_id"], "left").groupBy(*by, "query_id", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("hits"), F.min(F.when(F.col("rank") <= F.col("k"), F.col("rank"))).alias("first"))
    return per.join(total, [*held, "query_id"], "left")


def means(grouped: GroupedData) -> DataFrame:
    """Hit, MRR, precision and recall of grouped ``per_query`` rows."""
    return grouped.agg(
        F.avg((F.col("hits") > 0).cast("double")).alias("hit"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("hits") / F.col("k")).alias("precision"),
        F.coalesce(F.avg(F.col("hits") / F.col("total")), F.lit(0.0)).alias("recall"), F.count("*").alias("queries"),
    )


def verdict_rates(verdicts: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How often each flag is true; null counts as not true."""
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(f)).alias(f"{f}_count") for f in flags), *((F.count_if(F.col(f)) / F.count("*")).alias(f"{f}_rate") for f in flags))


def score_means(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(metric, mean, n_valid)`` of columns that may hold text; what is no number is left out."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.expr(f"try_cast(`{n}` as double)").alias("v")) for n in names))).alias("x")).select("x.*")
    valid = F.when(~F.isnan("v"), F.col("v"))
    return long.groupBy("metric").agg(F.avg(valid).alias("mean"), F.count(valid).alias("n_valid"))


def worst(rows: DataFrame, metric: str, ident: str = "id", n: int = 5) -> DataFrame:
    """The rows with the lowest score, those without one last, ties by id."""
    return rows.withColumn("_score", F.expr(f"try_cast(`{metric}` as double)")).orderBy(F.col("_score").asc_nulls_last(), ident).limit(n).drop("_score")


def judge_answer(text_column: str = "answer") -> Column:
    """A judge's JSON, or nulls with the answer's start as evidence where there is none."""
    body = F.regexp_extract(text_column, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "struct<faithful:boolean,hallucination:string,correct:boolean,reason:string>")
    good = F.try_parse_json(F.when(body != "", body)).isNotNull()
    return F.struct(
        F.when(good, parsed["faithful"]).alias("faithful"), F.when(good, parsed["hallucination"]).otherwise(F.left(text_column, F.lit(200))).alias("hallucination"),
        F.when(good, parsed["correct"]).alias("correct"), F.when(good, parsed["reason"]).alias("reason"),
    )


def first_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_turn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_turn = 1").drop("_turn")
