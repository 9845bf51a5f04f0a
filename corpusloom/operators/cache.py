"""The answer cache as a service uses it: lookups and stores are events of their own, and some questions must not use it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as X
from corpusloom.operators.service import ANSWER_TTL

LOOKUP, STORE = "lookup", "store"
HIT, MISS, BYPASS = "hit", "miss", "bypass"


def gated(question: Column, words: Sequence[str] = X.DEICTIC_WORDS, starts: Sequence[str] = X.DEICTIC_STARTS, ttl: int = ANSWER_TTL) -> Column:
    """Whether a question may be looked up: not if it leans on what was said before, nor if answers live for no time at all."""
    return F.lit(ttl > 0) & ~X.has_reference(question, words, starts)


def keyed(events: DataFrame, fingerprint: Column, words: Sequence[str] = X.DEICTIC_WORDS, starts: Sequence[str] = X.DEICTIC_STARTS, ttl: int = ANSWER_TTL) -> DataFrame:
    """``(event_id, ts, kind, key, open)`` of ``events(event_id, ts, kind, question, answer)`` as both cache forms take them.

    A store without an answer stores nothing, and is dropped. It is never gated: what it stores is a completed question. A null
    question is the empty one.
    """
    question = F.coalesce("question", F.lit(""))
    stores = F.col("kind") == STORE
    kept = events.where((F.col("kind") == LOOKUP) | (stores & (F.coalesce("answer", F.lit("")) != "") & F.lit(ttl > 0)))
    return kept.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "kind", X.cache_key(question, fingerprint).alias("key"),
        (stores | gated(question, words, starts, ttl)).alias("open"),
    )


def outcomes(events: DataFrame, ttl: int = ANSWER_TTL) -> DataFrame:
    """``(event_id, key, outcome, store_id)`` of each lookup in ``keyed`` events: hit, miss or bypass, and the store that a hit reads.

    A hit reads the last store of its key before it, if that is at most ``ttl`` seconds old; of equal times the lower event_id is
    earlier. A store can be read in its own stretch of ``ttl`` seconds and in the next one only, so keys are dealt out by
    stretches: however hot a key is, a task holds what falls in one life time of it, and only one row at a time.
    """
    life = max(ttl, 1) * 1_000_000
    asked = events.where(~F.col("open")).select("event_id", "key", F.lit(BYPASS).alias("outcome"), F.lit(None).cast("long").alias("store_id"))
    at = F.unix_micros("ts")
    stored = F.col("kind") == STORE
    ahead = F.explode(F.when(stored, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    dealt = events.where("open").withColumn("_at", at).withColumn("_ahead", ahead).withColumn("_stretch", F.floor(F.col("_at") / life) + F.col("_ahead"))
    before = W.partitionBy("key", "_stretch").orderBy("_at", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(stored, F.struct("_at", "event_id")), ignorenulls=True).over(before)
    met = dealt.withColumn("_last", last).where(F.col("kind") == LOOKUP)
    fresh = F.coalesce(F.col("_at") - F.col("_last._at") <= life, F.lit(False))
    found = met.select("event_id", "key", F.when(fresh, HIT).otherwise(MISS).alias("outcome"), F.when(fresh, F.col("_last.event_id")).alias("store_id"))
    return found.unionByName(asked)


def rates(found: DataFrame) -> DataFrame:
    """One row: lookups, hits, misses and bypasses, and the share of hits among those that were looked up (0 without any)."""
    n = {o: F.count_if(F.col("outcome") == o) for o in (HIT, MISS, BYPASS)}
    share = F.round(F.coalesce(F.try_divide(n[HIT], n[HIT] + n[MISS]), F.lit(0.0)), 6)
    return found.agg(F.count("*").alias("lookups"), n[HIT].alias("hits"), n[MISS].alias("misses"), n[BYPASS].alias("bypasses"), share.alias("hit_rate"))
