"""The service's state as streams: event time with watermarks, where late rows are dropped; state per key with a life time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.memory import KEEP, SUMMARY_CHARS, THRESHOLD
from corpusloom.operators.service import ANSWER_TTL, SESSION_TTL, WINDOW_SECONDS


def rates(events: DataFrame, by: str, seconds: int = WINDOW_SECONDS, slide: int = 15, late: str = "10 minutes") -> DataFrame:
    """Events per second in sliding windows; append mode, a window comes once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), by).agg(F.count("*").alias("n"))
    return counts.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", F.round(F.col("n") / seconds, 3).alias("rate"))


def sessions(events: DataFrame, key: str = "user_id", ttl: int = SESSION_TTL, late: str = "10 minutes") -> DataFrame:
    """Sessions that end ``ttl`` seconds after their last event; an event just then still belongs to them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", f"{ttl} seconds").alias("s"), key).agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return grouped.select(key, F.col("s.start").alias("start"), "end", "n")


def cached_answers(requests: DataFrame, key: str = "key", ttl: int = ANSWER_TTL, late: str = "10 minutes") -> DataFrame:
    """``(key, event_id, hit)`` of each request; the state of a key is the time of its last store and goes when that is stale."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        hits = []
        for at in rows["ts"]:
            ms = int(at.timestamp() * 1000)
            hits.append(stored is not None and ms - stored <= ttl * 1000)
            stored = stored if hits[-1] else ms
        state.update((stored,))
        state.setTimeoutTimestamp(max(stored + ttl * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"], "hit": hits})

    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    kind = dict(requests.dtypes)[key]
    return timed.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, hit boolean", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def memories(turns: DataFrame, keep: int = KEEP, threshold: int = THRESHOLD, chars: int = SUMMARY_CHARS) -> DataFrame:
    """``(conv_id, held, folded, summary)`` after each batch of ``turns(conv_id, turn, role, text)``: old messages go to a bounded summary."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, folded, summary, since = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, "", 0)
        rows = pd.concat(list(parts)).sort_values("turn")
        for role, text in zip(rows["role"], rows["text"], strict=True):
            held.append(f"{role}: {text or ''}")
            since += 1
            if since % 2 == 0 and len(held) > threshold:
                gone, held = held[:-keep], held[-keep:]
                folded += len(gone)
                summary = "\n".join([summary, *gone] if summary else gone)[-chars:]
        state.update((held, folded, summary, since))
        yield pd.DataFrame({"conv_id": [k[0]], "held": [len(held)], "folded": [folded], "summary": [summary]})

    out = "conv_id long, held long, folded long, summary string"
    return turns.groupBy("conv_id").applyInPandasWithState(run, out, "held array<string>, folded long, summary string, since long", "update", GroupStateTimeout.NoTimeout)
