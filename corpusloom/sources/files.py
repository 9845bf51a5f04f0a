"""Documents, golden sets and chat streams from files, and results back to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of file names and folder names that hold no documents.
EXCLUDED_NAMES = ("dirty_raw",)
EXCLUDED_FOLDERS = ("__pycache__", "node_modules", "venv", "deploy")

GOLDEN = "name string, version string, description string, doc_file string, queries array<struct<id:string,query:string,answer:string,section:string,golden_passages:array<string>>>"


def markdown(spark: SparkSession, folder: str, names: Sequence[str] = EXCLUDED_NAMES, folders: Sequence[str] = EXCLUDED_FOLDERS) -> DataFrame:
    """``(path, file_name, text)`` of all ``*.md`` below a folder. Hidden and excluded folders are judged below it only."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    # What follows the folder in the full name, whatever scheme and host precede it.
    root = "/" + folder.rstrip("/").split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    path = F.substring_index(F.url_decode(F.col("_metadata.file_path")), root, -1)
    parts = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = rows.select(path.alias("path"), F.substring_index(path, "/", -1).alias("file_name"), F.col("value").alias("text"), parts.alias("parts"))
    for n in names:
        out = out.where(~F.contains("file_name", F.lit(n)))
    return out.where(~F.exists("parts", lambda p: p.isin(*folders) | p.startswith("."))).drop("parts")


def fingerprint(docs: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """One row: a hash of all names and texts, whatever their order. Each document is hashed where it lies; only hashes are gathered."""
    each = docs.select(F.sha1(F.concat(F.col(name).cast("string"), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))).alias("h"))
    # Sums of the parts of the hashes don't depend on order and need no list of them.
    parts = [F.sum(F.conv(F.substring("h", i, 8), 16, 10).cast("decimal(38,0)")) for i in (1, 9, 17, 25, 33)]
    return each.agg(F.sha1(F.concat_ws("-", F.count("*").cast("string"), *(p.cast("string") for p in parts))).alias("fingerprint"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """``(id, query, answer, section, golden_passages)`` of a golden set in one JSON object."""
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def chat_deltas(lines: DataFrame) -> DataFrame:
    """``(request_id, seq, content, usage)`` of a model's stream lines ``(request_id, seq, line)``: up to [DONE], without malformed lines."""
    body = F.regexp_extract("line", r"^data:\s*(.*)$", 1)
    marked = lines.withColumn("body", body)
    done = marked.where("body = '[DONE]'").groupBy("request_id").agg(F.min("seq").alias("stop"))
    kept = marked.where("body <> '' and body <> '[DONE]'").join(done, "request_id", "left").where("stop is null or seq < stop")
    usage = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
    parsed = F.from_json("body", f"struct<choices:array<struct<delta:struct<content:string>>>,usage:{usage}>")
    rows = kept.where(F.try_parse_json("body").isNotNull()).withColumn("p", parsed)
    return rows.select("request_id", "seq", F.get(F.col("p.choices"), F.lit(0))["delta"]["content"].alias("content"), F.col("p.usage").alias("usage"))


def event_frames(events: DataFrame) -> DataFrame:
    """``events(request_id, seq, event struct)`` as frames of a push stream."""
    return events.select("request_id", "seq", F.concat(F.lit("data: "), F.to_json("event"), F.lit("\n\n")).alias("frame"))


def log_lines(events: DataFrame, fields: Sequence[str]) -> Column:
    """A JSON log line of the fields that are not null."""
    return F.to_json(F.struct(*fields))


def write_text(docs: DataFrame, path: str) -> None:
    """``docs(doc_id, text)`` as whole texts, one file per task."""
    docs.select(F.col("doc_id"), F.concat("text", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def test_set(samples: DataFrame) -> DataFrame:
    """Generated samples in the form of a golden set, with ids q01, q02, ... in the order of ``seq``."""
    number = F.col("seq").cast("string")
    ident = F.concat(F.lit("q"), F.when(F.char_length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    return samples.select(ident.alias("id"), F.col("user_input").alias("query"), F.col("reference").alias("answer"), F.col("reference_contexts").alias("golden_passages"))
