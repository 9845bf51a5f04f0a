"""Streams over files: the same rules as the batch operators, batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import service as batch
from corpusloom.streaming import service
from tests.conftest import DATA


def drain(df, mode="append"):
    name = f"t{uuid.uuid4().hex}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return df.sparkSession.table(name)
    finally:
        query.stop()


def stream(spark, df, path, parts=3):
    """Rows of ``df`` as a stream of several files, in the order of ts."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def events(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return rows.withColumn("part", F.least(F.floor(F.dayofmonth("ts") / 11), F.lit(2)).cast("int"))


def test_sessions_end_as_in_batch(spark, tmp_path):
    got = drain(service.sessions(stream(spark, events(spark), tmp_path / "s"))).select("user_id", "start", "n")
    want = batch.sessions(spark.read.parquet(f"{DATA}/events.parquet")).select("user_id", F.col("start").cast("timestamp").alias("start"), "n")
    # The last sessions are still open when the stream ends; all closed ones are those of the batch.
    assert got.count() > 0
    assert got.subtract(want).count() == 0


def test_rates(spark, tmp_path):
    got = drain(service.rates(stream(spark, events(spark), tmp_path / "r"), "event_type", 3600, 3600))
    want = events(spark).groupBy("event_type", F.window("ts", "1 hour").start.alias("start")).count()
    assert got.count() > 0
    assert got.select("event_type", "start", "n").subtract(want).count() == 0


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([("k", e, t, p) for e, t, p in ((0, 0, 0), (1, 100, 0), (2, 3600, 1), (3, 3601, 1), (4, 7300, 2))], "key string, event_id long, t long, part int")
    rows = rows.select("key", "event_id", F.timestamp_seconds(F.col("t") + 1_000_000_000).alias("ts"), "part")
    got = drain(service.cached_answers(stream(spark, rows, tmp_path / "c")))
    assert [r["hit"] for r in got.orderBy("event_id").collect()] == [False, True, True, False, False]


def test_memory(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", i // 7) for i in range(20)], "conv_id long, turn long, role string, text string, part int")
    got = drain(service.memories(stream(spark, rows, tmp_path / "m")), "update").orderBy(F.desc("folded"), F.desc("held")).first()
    assert (got["held"], got["folded"]) == (8, 12)
    assert got["summary"].endswith("assistant: m11")
