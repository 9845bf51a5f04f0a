"""Questions as they come, each batch answered once: hits, messages and frames, written by batch so that a repeated one leaves nothing double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.jobs import answer
from corpusloom.operators import fusion
from corpusloom.sources import files


def frames(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``(request_id, seq, frame)``: for each question one frame with its sources in order, an empty list if it has none, then ``done``."""
    shown = fusion.public(hits.withColumn("rank", F.col("final_rank")))
    ordered = shown.join(hits.select("query_id", "idx", "final_rank"), ["query_id", "idx"])
    item = F.struct("final_rank", "idx", "file", "text", "snippet", "rerank", "origins")
    listed = ordered.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    sources = F.transform(F.coalesce("l", F.array()), lambda h: F.struct(h["idx"].alias("idx"), h["file"].alias("file"), h["snippet"].alias("snippet"), h["rerank"].alias("rerank"), h["origins"].alias("origins")))
    told = questions.select("query_id").join(listed, "query_id", "left").withColumn("hits", sources)
    none = F.lit(None).cast(told.schema["hits"].dataType)
    said = F.array(F.struct(F.lit("sources").alias("type"), F.col("hits").alias("hits")), F.struct(F.lit("done").alias("type"), none.alias("hits")))
    events = told.select(F.col("query_id").alias("request_id"), F.posexplode(said).alias("seq", "event"))
    return files.event_frames(events)


def write_batch(questions: DataFrame, docs: DataFrame, path: str, batch: int, system: str, base_k: int = 6) -> None:
    """The hits' messages and frames of one batch, in folders of its number: writing it again replaces them."""
    hits = answer.answered(questions, docs, base_k)
    answer.prompts(hits, system).write.mode("overwrite").parquet(f"{path}/messages/batch={batch}")
    frames(questions, hits).write.mode("overwrite").parquet(f"{path}/frames/batch={batch}")


def answers(questions: DataFrame, docs: DataFrame, path: str, checkpoint: str, system: str, base_k: int = 6) -> DataStreamWriter:
    """A stream of ``questions(query_id, question, intent)`` answered from ``docs(doc_id, file_name, text)``; the caller starts it.

    A batch that failed is run again with its number by the checkpoint, and overwrites what it left.
    """

    def run(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            write_batch(rows, docs, path, batch, system, base_k)

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
