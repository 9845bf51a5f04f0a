"""Rank fusion, merging of variants' hits, slot weighting and reranking, as joins, sums and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions.text import snippet

RANK_CONSTANT = 60
# Slot types that a hit has to speak of, and the weight of hits that don't.
CRITICAL_SLOTS = ("region", "time", "policy_type", "product_category")
MISSED_WEIGHT = 0.35


def reciprocal_rank(left: DataFrame, right: DataFrame, constant: int = RANK_CONSTANT) -> DataFrame:
    """Fuse two lists ``(query_id, idx, rank, score)``: ``(query_id, idx, rrf, left_score, right_score)``.

    With whole rankings the result is exact; with candidate lists a hit missing from one adds nothing there.
    """
    a = left.select("query_id", "idx", F.col("rank").alias("ra"), F.col("score").alias("left_score"))
    b = right.select("query_id", "idx", F.col("rank").alias("rb"), F.col("score").alias("right_score"))

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))

    return a.join(b, ["query_id", "idx"], "full_outer").select("query_id", "idx", (part("ra") + part("rb")).alias("rrf"), "left_score", "right_score")


def ranked(hits: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """``hits`` with the rank in its query, by score, ties by idx."""
    return hits.withColumn(name, F.row_number().over(W.partitionBy("query_id").orderBy(F.col(by).desc(), "idx")).cast("long"))


def widths(scale: Column, base: int = 6) -> tuple[Column, Column]:
    """(top_k, fetch_k) for a recall scale; halves go to the even number."""
    k = F.greatest(F.lit(1), F.bround(F.lit(base) * scale).cast("int"))
    return k, F.greatest(2 * k, k + 4)


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits of a query's variants, ``(query_id, seq, origin, idx, rrf, vec_sim, bm25)``, by idx.

    score sums rrf; vec_sim and bm25 are the largest, 0 at least; origins are distinct and sorted; ``lead`` is the origin of
    the hit with the greatest rrf, the first by seq of equal ones.
    """
    return hits.groupBy("query_id", "idx").agg(
        F.sum("rrf").alias("score"), F.greatest(F.max("vec_sim"), F.lit(0.0)).alias("vec_sim"), F.greatest(F.max("bm25"), F.lit(0.0)).alias("bm25"),
        F.array_sort(F.collect_set("origin")).alias("origins"), F.max_by("origin", F.struct("rrf", -F.col("seq"))).alias("lead"),
    )


def weigh_slots(hits: DataFrame, slots: DataFrame, text: str = "text", missed: float = MISSED_WEIGHT) -> DataFrame:
    """``hits`` plus slot_matched and slot_score by ``slots(query_id, slots array<struct<type,value>>)``.

    Values of critical slots are looked for in the text. Queries without such slots keep their scores.
    """
    wanted = F.transform(F.filter(F.coalesce("slots", F.array()), lambda s: s["type"].isin(*CRITICAL_SLOTS) & (s["value"] != "")), lambda s: s["value"])
    joined = hits.join(slots.select("query_id", "slots"), "query_id", "left").withColumn("wanted", wanted)
    matched = F.filter("wanted", lambda v: F.contains(F.col(text), v))
    out = joined.withColumn("slot_matched", matched)
    weight = F.when((F.size("wanted") == 0) | (F.size("slot_matched") > 0), 1.0).otherwise(missed)
    return out.withColumn("slot_score", F.col("score") * weight).drop("slots", "wanted")


def rerank(hits: DataFrame, score: Callable[[Column, Column], Column], pool: Column, by: str = "score", query: str = "query", text: str = "text") -> DataFrame:
    """The best ``pool`` hits of each query in the order of a scorer, then the others as they were: ``final_rank``, ``rerank_score``.

    Only the pool is scored. Of equal scores the better earlier rank comes first.
    """
    pooled = ranked(hits, by, "first_rank").withColumn("in_pool", F.col("first_rank") <= pool)
    scored = pooled.withColumn("rerank_score", F.when(F.col("in_pool"), score(F.col(query), F.col(text))))
    order = W.partitionBy("query_id").orderBy(F.col("in_pool").desc(), F.col("rerank_score").desc_nulls_last(), "first_rank")
    return scored.withColumn("final_rank", F.row_number().over(order).cast("long")).drop("in_pool")


def lexical_overlap(query: Column, text: Column) -> Column:
    """A scorer without a model: the share of a query's distinct words that the text has."""
    from corpusloom.operators.lexical import word_tokens

    asked = F.array_distinct(word_tokens(query))
    return F.size(F.array_intersect(asked, word_tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def scored_response(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """Scores by position from a rerank service's JSON: ``asked(query_id, index)`` and ``responses(query_id, body)``; what is missing is 0."""
    found = responses.select("query_id", F.explode(F.from_json("body", "struct<results:array<struct<index:int,relevance_score:double>>>")["results"]).alias("r")).select("query_id", "r.*")
    return asked.join(found, ["query_id", "index"], "left").select("query_id", "index", F.coalesce("relevance_score", F.lit(0.0)).alias("score"))


def public(hits: DataFrame, text: str = "text") -> DataFrame:
    """Hits as a client gets them: ``(query_id, idx, file, text, snippet, rerank, rrf, vec_sim, bm25, origins)``; what a hit lacks is null, or empty for file, text and origins."""

    def has(name: str, kind: str) -> Column:
        return F.col(name) if name in hits.columns else F.lit(None).cast(kind)

    said = F.coalesce(has(text, "string"), F.lit(""))
    return hits.select(
        "query_id", "idx", F.coalesce(has("file_name", "string"), F.lit("")).alias("file"), said.alias("text"), snippet(said).alias("snippet"), has("rerank_score", "double").alias("rerank"),
        *(has(c, "double").alias(c) for c in ("rrf", "vec_sim", "bm25")), F.coalesce(has("origins", "array<string>"), F.array().cast("array<string>")).alias("origins"),
    )
