"""Conversation windows, folding of old turns, and the text that a model gets: windows by conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

# How speakers are named, and the limits of the window and of the summary.
USER, ASSISTANT = "用户：", "助手："
MAX_MESSAGES, MAX_CHARS = 8, 2400
KEEP, THRESHOLD, SUMMARY_CHARS = 8, 12, 1200


def newest() -> WindowSpec:
    """A conversation's messages, last first."""
    return W.partitionBy("conv_id").orderBy(F.col("turn").desc())


def recent_window(turns: DataFrame, messages: int = MAX_MESSAGES, chars: int = MAX_CHARS) -> DataFrame:
    """Each conversation's last messages within both limits; the last one always stays. ``cut_by_chars`` counts those the budget drops."""
    sized = turns.withColumns({"rn": F.row_number().over(newest()), "total": F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(newest().rowsBetween(W.unboundedPreceding, 0))})
    inside = sized.where(F.col("rn") <= messages)
    kept = (F.col("total") <= chars) | (F.col("rn") == 1)
    cut = F.sum((~kept).cast("int")).over(W.partitionBy("conv_id"))
    return inside.withColumn("kept", kept).withColumn("cut_by_chars", cut.cast("long")).where("kept").drop("rn", "total", "kept")


def _label(role: Column, user: str, other: str) -> Column:
    return F.when(role == "user", user).otherwise(other)


def dialogue(turns: DataFrame, user: str = USER, other: str = ASSISTANT) -> DataFrame:
    """``(conv_id, dialogue)``: one labelled line per message, in order."""
    line = F.concat(_label(F.col("role"), user, other), F.coalesce("text", F.lit("")))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return gathered.select("conv_id", F.array_join(F.col("l.line"), "\n").alias("dialogue"))


def fold(turns: DataFrame, keep: int = KEEP, threshold: int = THRESHOLD) -> DataFrame:
    """Messages after memory upkeep, with ``folded``: how many of the conversation went to its summary.

    Upkeep runs after each question and answer. Once more than ``threshold`` messages are held all but ``keep`` are folded; held
    counts then climb by two from ``keep``. So after n messages, of which whole pairs p count, ``step`` more were folded each time p passed a multiple.
    """
    step = threshold - keep + 2
    n = F.count("*").over(W.partitionBy("conv_id"))
    pairs = (F.floor(n / 2) * 2).cast("int")
    # Held messages reach threshold + 2 every `step` messages, and each time `step` of them go.
    folds = F.greatest(F.floor((pairs - keep) / step), F.lit(0))
    placed = turns.withColumn("folded", (folds * step).cast("long")).withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    return placed.withColumn("in_summary", F.col("nth") <= F.col("folded")).drop("nth")


def summaries(folded: DataFrame, chars: int = SUMMARY_CHARS) -> DataFrame:
    """``(conv_id, summary)`` without a model: the end of the folded dialogue."""
    return dialogue(folded.where("in_summary")).select("conv_id", F.right("dialogue", F.lit(chars)).alias("summary"))


def context(hits: DataFrame) -> DataFrame:
    """``(query_id, context)`` of ``hits(query_id, rank, file_name, text)``: numbered passages in rank order."""
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]（"), F.col("file_name"), F.lit("）\n"), F.col("text"))
    gathered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))).alias("l"))
    return gathered.select("query_id", F.array_join(F.col("l.p"), "\n\n").alias("context"))


def messages(system: str, context: Column, question: Column, summary: Column, recent: Column) -> Column:
    """The messages for a model: the rules, then what was said and found, then the question; null parts are left out."""
    body = F.concat_ws("\n\n", F.concat(F.lit("【对话摘要】\n"), summary), F.concat(F.lit("【最近对话】\n"), recent), F.concat(F.lit("【资料】\n"), context), F.concat(F.lit("【问题】\n"), question))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


# Fixed value: what a model is told where nothing else asks it for JSON.
JSON_HINT = "请以 JSON 对象输出。"


def json_hint(said: Column, hint: str = JSON_HINT) -> Column:
    """``said`` (messages), told to answer in JSON unless one says so: the hint ends a leading system message, else it comes first as one."""
    spoken = F.exists(said, lambda m: F.contains(F.lower(F.coalesce(m["content"], F.lit(""))), F.lit("json")))
    first = F.get(said, F.lit(0))
    longer = F.struct(first["role"].alias("role"), F.concat(F.coalesce(first["content"], F.lit("")), F.lit("\n" + hint)).alias("content"))
    alone = F.struct(F.lit("system").alias("role"), F.lit(hint).alias("content"))
    headed = F.coalesce(first["role"] == "system", F.lit(False))
    led = F.when(headed, F.concat(F.array(longer), F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))))).otherwise(F.concat(F.array(alone), said))
    return F.when(spoken, said).otherwise(led)
