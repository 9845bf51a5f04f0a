"""Long jobs in parts that a rerun need not do again: what a part was made of is noted last, and parts noted wrongly are made anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "part int, n long, mark long, made long"


def parted(items: DataFrame, key: str, parts: int) -> DataFrame:
    """``items`` plus part, by a hash of the key alone, so that a part holds the same keys in every run."""
    return items.withColumn("part", F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int"))


def summary(items: DataFrame) -> DataFrame:
    """``(part, n, mark)`` of parted items: rows, and a sum of hashes of all they hold, whatever their order."""
    columns = [c for c in items.columns if c != "part"]
    # Half of each hash is summed, so that 2^31 rows of a part stay within a long.
    return items.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64(*columns), 32)).alias("mark"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _noted(spark: SparkSession, path: str, part: int) -> tuple | None:
    """What the note of a part says, if its rows are all there."""
    if not _exists(spark, f"{path}/notes/part={part}/_SUCCESS"):
        return None
    note = spark.read.schema(NOTE.replace("part int, ", "")).parquet(f"{path}/notes/part={part}").first()
    if note is None or not _exists(spark, f"{path}/rows/part={part}/_SUCCESS"):
        return None
    return (note["n"], note["mark"]) if spark.read.parquet(f"{path}/rows/part={part}").count() == note["made"] else None


def resumed(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, parts: int = 16) -> DataFrame:
    """``work(items)`` by parts below ``path``, of which those done before from the same items are read and not made.

    A part's rows are written, then its note: a run that was killed leaves rows without a note, which the next one overwrites. A
    part is made anew if its items changed in any column, if rows are missing, or if the note is. ``work`` treats items apart from
    each other. ``path`` is in a folder that all executors share. Choose ``parts`` by how much work may be lost; one row a part comes to
    the driver. No items give no rows, with the columns of ``work``.
    """
    spark, dealt = items.sparkSession, parted(items, key, parts)
    wanted = {r["part"]: (r["n"], r["mark"]) for r in summary(dealt).collect()}
    todo = [p for p, mark in sorted(wanted.items()) if _noted(spark, path, p) != mark]
    if todo:
        # Only items of parts to be made are written, by part, so that each part reads its own.
        dealt.where(F.col("part").isin(*todo)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/items")
    for p in todo:
        own = spark.read.schema(items.schema).parquet(f"{path}/items/part={p}")
        work(own).write.mode("overwrite").parquet(f"{path}/rows/part={p}")
        made = spark.read.parquet(f"{path}/rows/part={p}").count()
        n, mark = wanted[p]
        spark.createDataFrame([(n, mark, made)], NOTE.replace("part int, ", "")).coalesce(1).write.mode("overwrite").parquet(f"{path}/notes/part={p}")
    shape = work(items.limit(0)).schema
    if not wanted:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(*(f"{path}/rows/part={p}" for p in sorted(wanted)))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """``(part, n, mark, made)`` of all parts noted below ``path``."""
    return spark.read.schema(NOTE).parquet(f"{path}/notes").select("part", "n", "mark", "made")
