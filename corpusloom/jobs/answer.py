"""Questions to messages in one job: variants of each question, their hits, merged, weighed by slots, reranked, and the prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import fusion, intent, lexical, memory, ranking
from corpusloom.storage import stored


def variant_hits(questions: DataFrame, docs: DataFrame, base_k: int = 6, digits: int = 6, tokens: Callable[[Column], Column] = lexical.word_tokens) -> DataFrame:
    """``(query_id, variant, origin, text, fetch_k, idx, rank, score, failed)`` of ``questions(query_id, question, intent)``.

    Each variant gets as many hits of ``docs(doc_id, text)`` as its question's recall scale asks for, all variants of a block in one pass.
    A variant without any hit is a row of its own, ``failed``, and stops nobody else's.
    """
    _, fetch_k = fusion.widths(F.col("intent.recall_scale"), base_k)
    wide = questions.select("query_id", fetch_k.cast("long").alias("fetch_k"))
    rows = intent.variants(questions).join(wide, "query_id").withColumn("key", F.xxhash64("query_id", "variant"))
    cut = docs.select("doc_id", tokens(F.col("text")).alias("tokens"))
    terms, mean = ranking.statistics(cut)
    hits = None
    for asked in ranking.blocks(rows.select(F.col("key").alias("query_id"), tokens(F.col("text")).alias("words"), "fetch_k")):
        part = ranking.head(cut, ranking.bm25(asked, terms, mean, digits), asked.column("fetch_k").to_numpy())
        hits = part if hits is None else hits.unionByName(part)
    found = hits.withColumnRenamed("query_id", "key")
    return rows.join(found, "key", "left").select("query_id", "variant", "origin", "text", "fetch_k", "idx", "rank", "score", F.col("idx").isNull().alias("failed"))


def answered(questions: DataFrame, docs: DataFrame, base_k: int = 6, scorer: Callable[[Column, Column], Column] = fusion.lexical_overlap) -> DataFrame:
    """The hits that answer ``questions(query_id, question, intent)`` from ``docs(doc_id, file_name, text)``.

    ``(query_id, final_rank, idx, origins, score, slot_score, rerank_score, file_name, text, question)``: variants' hits merged by document, weighed by
    the intent's slots, the best of a pool reranked, and cut to the question's width.
    """
    top_k, _ = fusion.widths(F.col("intent.recall_scale"), base_k)
    found = variant_hits(questions, docs, base_k).where("not failed")
    seq = F.col("variant").cast("long") * F.lit(1 << 32) + F.col("rank")
    merged = fusion.merge_hits(found.select("query_id", seq.alias("seq"), "origin", "idx", F.round(1.0 / (fusion.RANK_CONSTANT + F.col("rank")), 9).alias("rrf"), F.lit(0.0).alias("vec_sim"), F.col("score").alias("bm25")))
    texts = docs.select(F.col("doc_id").alias("idx"), "file_name", "text")
    asked = questions.select("query_id", "question", F.col("intent.slots").alias("slots"), top_k.alias("top_k"))
    weighed = fusion.weigh_slots(merged.withColumn("score", F.round("score", 9)).join(texts, "idx"), asked).withColumn("slot_score", F.round("slot_score", 12))
    pool = F.greatest(3 * F.col("top_k"), F.col("top_k") + 8)
    ranked = fusion.rerank(weighed.join(asked.drop("slots"), "query_id"), lambda q, t: F.round(scorer(q, t), 9), pool, "slot_score", "question")
    # Few rows a question, read by the prompt and by whoever lists sources: stored, so that the search runs once.
    return stored(ranked.where(F.col("final_rank") <= F.col("top_k")).select("query_id", "final_rank", "idx", "origins", "score", "slot_score", "rerank_score", "file_name", "text", "question"))


def direct(questions: DataFrame, docs: DataFrame, base: DataFrame, base_k: int = 6, scorer: Callable[[Column, Column], Column] = fusion.lexical_overlap) -> DataFrame:
    """The hits of ``questions(query_id, text, vector)`` asked as they are, without intent, variants or slots: fused, all fetched hits reranked, cut.

    ``(query_id, final_rank, idx, rerank_score, rrf, bm25, vec_sim, file_name, text, question)`` of ``docs(doc_id, file_name, text)`` and
    ``base(id, vector)``. As wide as an intent of scale 1 would be.
    """
    top_k, fetch_k = base_k, max(2 * base_k, base_k + 4)
    hits = ranking.hybrid_top(questions, docs.select("doc_id", "text"), base, fetch_k)
    asked = questions.select("query_id", F.col("text").alias("question"))
    texts = docs.select(F.col("doc_id").alias("idx"), "file_name", "text")
    met = hits.join(texts, "idx").join(asked, "query_id").withColumnsRenamed({"left_score": "bm25", "right_score": "vec_sim"})
    ranked = fusion.rerank(met, lambda q, t: F.round(scorer(q, t), 9), F.lit(fetch_k), "rrf", "question").where(F.col("final_rank") <= top_k)
    return stored(ranked.select("query_id", "final_rank", "idx", "rerank_score", "rrf", "bm25", "vec_sim", "file_name", "text", "question"))


def prompts(hits: DataFrame, system: str) -> DataFrame:
    """``(query_id, n_hits, messages)`` of answered hits."""
    context = memory.context(hits.select("query_id", F.col("final_rank").alias("rank"), "file_name", "text"))
    asked = hits.groupBy("query_id").agg(F.first("question").alias("question"), F.count("*").alias("n_hits"))
    none = F.lit(None).cast("string")
    return asked.join(context, "query_id").select("query_id", "n_hits", memory.messages(system, F.col("context"), F.col("question"), none, none).alias("messages"))
