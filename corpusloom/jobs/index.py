"""Build a retrieval index as tables, answer batches of questions from it, and evaluate ways to cut and rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluation, fusion, lexical, vectors
from corpusloom.sources.files import fingerprint

TABLES = ("chunks", "postings", "lengths", "vectors")
#: Steps of the scores in which rankings are worked out.
WORD_STEP, SENSE_STEP = 0.25, 0.01


def chunk_table(docs: DataFrame, cut: Callable, ident: str = "doc_id") -> DataFrame:
    """``(idx, doc_id, chunk, start, end, text)``: idx is a hash of document and place, so no global numbering is needed."""
    rows = chunking.chunks(docs.select(F.col(ident).alias("doc_id"), "text"), cut)
    return rows.select(F.xxhash64("doc_id", "chunk").alias("idx"), "doc_id", "chunk", "start", "end", F.col("chunk_text").alias("text"))


def build(docs: DataFrame, path: str, cut: Callable, name: str = "doc_id") -> str:
    """Write the index of ``docs`` below ``path`` unless one of the same fingerprint is there; returns the fingerprint."""
    spark = docs.sparkSession
    mark = fingerprint(docs, name).first()["fingerprint"]
    if _stored(spark, path) == mark:
        return mark
    chunk_table(docs, cut, name).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    if chunks.isEmpty():
        raise ValueError("there is nothing to index")
    texts = chunks.select(F.col("idx").alias("doc_id"), "text")
    lexical.postings(texts).write.mode("overwrite").parquet(f"{path}/postings")
    lexical.lengths(texts).write.mode("overwrite").parquet(f"{path}/lengths")
    vectors.hash_vectors(texts).write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(mark,)], "fingerprint string").write.mode("overwrite").parquet(f"{path}/fingerprint")
    return mark


def _stored(spark: SparkSession, path: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/fingerprint/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(f"{path}/fingerprint").first()["fingerprint"]


def retrieve(spark: SparkSession, path: str, questions: DataFrame, k: int = 6) -> DataFrame:
    """``(query_id, rank, idx, rrf, bm25, vec_sim, doc_id, text)``: both whole rankings fused, for all ``questions(query_id, text)`` in one job."""
    read = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    by_words = lexical.full_ranks(lexical.bm25(questions, read["postings"], read["lengths"]), WORD_STEP).withColumnRenamed("doc_id", "idx")
    asked = vectors.hash_vectors(questions.select(F.col("query_id").alias("doc_id"), "text")).withColumnRenamed("id", "query_id")
    by_sense = lexical.full_ranks(vectors.cosine_scores(asked, read["vectors"]), SENSE_STEP, "sim", "id").select("query_id", F.col("id").alias("idx"), "rank", F.col("sim").alias("score"))
    fused = fusion.reciprocal_rank(by_words.select("query_id", "idx", "rank", "score"), by_sense)
    best = fusion.ranked(fused, "rrf").where(F.col("rank") <= k)
    return best.join(read["chunks"].select("idx", "doc_id", "text"), "idx").select("query_id", "rank", "idx", "rrf", F.col("left_score").alias("bm25"), F.col("right_score").alias("vec_sim"), "doc_id", "text")


def evaluate(docs: DataFrame, passages: DataFrame, questions: DataFrame, strategies: dict[str, Callable], k: int = 5) -> DataFrame:
    """Metrics by strategy of cutting, all in one job, ranked by BM25 over the chunks of each."""
    parts = None
    for name, cut in strategies.items():
        rows = chunk_table(docs, cut).withColumn("strategy", F.lit(name))
        parts = rows if parts is None else parts.unionByName(rows)
    chunks = parts.withColumn("idx", F.xxhash64("strategy", "idx"))
    spans = evaluation.gold_spans(passages, docs)
    relevance = evaluation.relevant(chunks.select("doc_id", F.col("idx").alias("chunk"), "start", "end"), spans).select("query_id", F.col("chunk").alias("idx"))
    relevance = relevance.join(chunks.select("idx", "strategy"), "idx").select("strategy", "query_id", "idx")
    ranked = None
    for name in strategies:
        texts = chunks.where(F.col("strategy") == name).select(F.col("idx").alias("doc_id"), "text")
        rows = lexical.top(lexical.bm25(questions, lexical.postings(texts), lexical.lengths(texts)), k).select(F.lit(name).alias("strategy"), "query_id", F.col("doc_id").alias("idx"), "rank")
        ranked = rows if ranked is None else ranked.unionByName(rows)
    asked = questions.select("query_id").crossJoin(chunks.sparkSession.createDataFrame([(n,) for n in strategies], "strategy string"))
    return evaluation.metrics(ranked, relevance, asked, ["idx"], by=["strategy"])
