"""Documents through language ID, line dedup, near-duplicate removal, decontamination and tokens, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, language_id, line_dedup, ngram_join, phrase_index, queries, scratch

#: Documents whose language gets a smaller share than this are rejected.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without letters or with an unclear language go."""
    out = language_id.predict(docs, language_id.train(docs.select("text", "lang")))
    return out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE)).select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go but for their first place; a document that had nothing else goes too. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).where((F.col("_n_removed") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    return out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return phrase_index.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of the ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs.select("doc_id", "text"), queries.RANKS, public_tokenizers.PATTERN)


STAGES = [("language_id", identify_language), ("line_dedup", cut_lines), ("ngram_jaccard_join", drop_near_duplicates), ("decontamination", decontaminate), ("byte_bpe", tokenize)]

#: The stages learn, join by similarity and tokenize beyond what SQL expresses; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again."""
    tables, docs = scratch.Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return docs
