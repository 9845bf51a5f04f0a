"""Connected components by alternating large and small stars: a few joins and minima, no group collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), F.col("b")).where("a <> b").distinct()
    # Small star: the larger end of each edge hands its smaller neighbours to the least of them.
    least = large.groupBy("b").agg(F.min("a").alias("m"))
    hung = large.join(least, "b")
    return hung.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``; component is the least id that can be reached.

    Ids on no edge have no row. Nulls and self-links are dropped. Each round's edges are written, so a lost
    executor repeats one round at most; rounds grow with the logarithm of the longest path.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, seen, turn = scratch.save(now, f"{name}-0"), None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen, turn = tuple(state), turn + 1
        now = scratch.save(_stars(now), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
