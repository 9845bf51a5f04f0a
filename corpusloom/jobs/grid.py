"""Ways to cut against ways to rank: every pair on the same questions, reported apart and together."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluation, fusion, lexical, ranking
from corpusloom.storage import stored

RANKERS = ("vector", "bm25", "rrf", "rrf+rerank")
ALL = "all"
#: Places of a chunk in its document's share of the ids.
PLACES = 1 << 24
#: Questions that are answered by one pass of each ranker.
QUESTIONS = 8192


def index(docs: DataFrame, strategies: dict[str, Callable[[Column], Column]], embed: Callable[[Column], Column], tokens: Callable[[Column], Column] = lexical.word_tokens) -> DataFrame:
    """``(strategy, idx, doc_id, start, end, text, vector, tokens)`` of ``docs(doc_id, text)`` cut in all ways, stored once for all rankers; words are cut as they are read, which is once for each block of questions."""
    parts = None
    for name, cut in strategies.items():
        rows = chunking.chunks(docs.select("doc_id", "text"), cut).select(F.lit(name).alias("strategy"), (F.col("doc_id") * PLACES + F.col("chunk")).alias("idx"), "doc_id", "start", "end", F.col("chunk_text").alias("text"))
        parts = rows if parts is None else parts.unionByName(rows)
    held = stored(parts.withColumn("vector", embed(F.col("text"))))
    return held.withColumn("tokens", tokens(F.col("text")))


def rankings(chunks: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], k: int, pool: int, digits: int = 6, scorer: Callable[[Column, Column], Column] = fusion.lexical_overlap) -> DataFrame:
    """``(ranker, query_id, idx, rank)``: the k best chunks ``(idx, text, tokens, vector)`` of ``questions(query_id, text)`` by each of RANKERS.

    Only heads of lists leave the tasks; the fusion's first ``pool`` are reranked.
    """
    by_sense = chunks.select("idx", "vector")
    asked = questions.select("query_id", lexical.word_tokens(F.col("text")).alias("words"), embed(F.col("text")).alias("vector"))
    out = None
    for block in ranking.blocks(asked, QUESTIONS):
        names = ranking.vocabulary(block)
        by_words, terms, mean = ranking.indexed(chunks.select("idx", "tokens"), names)
        words, sense = ranking.bm25(block, terms, mean, digits, names), ranking.cosine(block.filter(pc.is_valid(block.column("vector"))), digits)
        # The heads that the fusion reads begin with what the rankers alone find.
        heads = ranking.heads_for(by_words, words, by_sense, sense, max(pool, k))
        fused = ranking.fused_top(by_words, words, by_sense, sense, max(pool, k), heads=heads).where(F.col("rank") <= pool)
        alone = [chunks.sparkSession.createDataFrame(h.filter(pc.less_equal(h.column("rank"), k))) for h in heads]
        found = None
        for name, rows in (("vector", alone[1]), ("bm25", alone[0]), ("rrf", fused)):
            named = rows.select(F.lit(name).alias("ranker"), "query_id", "idx", "rank")
            found = named if found is None else found.unionByName(named)
        # A pool of few rows a question, read by two rankers: stored, so that the search runs once.
        found = stored(found)
        pooled = chunks.select("idx", "text").join(F.broadcast(found.where("ranker = 'rrf'")), "idx").join(questions.select("query_id", F.col("text").alias("query")), "query_id")
        again = fusion.rerank(pooled.withColumn("score", -F.col("rank")), lambda q, t: F.round(scorer(q, t), 9), F.lit(pool))
        rows = found.unionByName(again.select(F.lit("rrf+rerank").alias("ranker"), "query_id", "idx", F.col("final_rank").alias("rank"))).where(F.col("rank") <= k)
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluate(docs: DataFrame, questions: DataFrame, spans: DataFrame, strategies: dict[str, Callable[[Column], Column]], embed: Callable[[Column], Column], top: tuple[int, ...] = evaluation.TOP, pool: int = 20) -> DataFrame:
    """``(strategy, ranker, k, hit, mrr, precision, recall, queries)`` for each pair, and over all strategies or all rankers (``all``), by one set of grouping sets.

    ``questions(query_id, text)`` are a stated set; ``spans(query_id, doc_id, gs, ge)`` say where their answers lie.
    """
    chunks = index(docs, strategies, embed)
    near = stored(evaluation.relevant(chunks.select("doc_id", F.struct("strategy", "idx").alias("chunk"), "start", "end"), spans))
    relevance = near.select("query_id", "chunk.strategy", "chunk.idx")
    # Questions that say the same are asked once.
    firsts = stored(questions.groupBy("text").agg(F.min("query_id").alias("query_id")))
    turns = stored(questions.join(firsts.withColumnsRenamed({"query_id": "_first", "text": "_text"}), F.col("text").eqNullSafe(F.col("_text"))).select("query_id", "_first"))
    ranked = None
    for name in strategies:
        found = rankings(chunks.where(F.col("strategy") == name), firsts, embed, max(top), pool).withColumnRenamed("query_id", "_first")
        rows = turns.join(found, "_first").select("ranker", "query_id", "idx", "rank", F.lit(name).alias("strategy"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(r).alias("ranker")) for s in strategies for r in RANKERS)))
    asked = questions.select("query_id", pairs.alias("p")).select("query_id", "p.*")
    per = evaluation.per_query(ranked, relevance, asked, ["idx"], top, ["strategy", "ranker"])
    sets = [["strategy", "ranker", "k"], ["strategy", "k"], ["ranker", "k"]]
    found = evaluation.means(per.groupingSets([[F.col(c) for c in s] for s in sets], "strategy", "ranker", "k"))
    return found.withColumns({c: F.coalesce(c, F.lit(ALL)) for c in ("strategy", "ranker")})
