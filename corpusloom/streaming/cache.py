"""The answer cache as a stream: one state machine a key, fed by lookups and stores that may come late and in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.cache import BYPASS, HIT, LOOKUP, MISS, STORE
from corpusloom.operators.service import ANSWER_TTL

OUT = "event_id long, key string, outcome string, store_id long"


class AnswerCache(StatefulProcessor):
    """Events wait until the watermark has passed them, and are then run in the order of (ts, event_id); so the batch decides nothing.

    State of a key: the events that wait, bounded by the watermark's delay, and the last store. A timer stands at the first waiting
    event, or at the end of the stored answer's life, when the key is forgotten.
    """

    def __init__(self, ttl: int) -> None:
        self.life = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at long, event_id long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string, open boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(rows))
        at = come["ts"].astype("datetime64[us]").astype("int64")
        self.waiting.appendList([(int(t), int(i), str(k), bool(o)) for t, i, k, o in zip(at, come["event_id"], come["kind"], come["open"], strict=True)])
        self._wake(int(at.min()) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [e for e in events if e[0] < mark], [e for e in events if e[0] >= mark]
        stored = tuple(self.stored.get()) if self.stored.exists() else None
        out = []
        for at, event_id, kind, open_ in due:
            if kind == STORE:
                stored = (at, event_id)
            elif kind == LOOKUP:
                fresh = open_ and stored is not None and at - stored[0] <= self.life
                out.append((event_id, key[0], HIT if fresh else MISS if open_ else BYPASS, stored[1] if fresh else None))
        self._keep(stored if stored is not None and (rest or stored[0] + self.life >= mark) else None, rest)
        found = pd.DataFrame(out, columns=["event_id", "key", "outcome", "store_id"])
        yield found.astype({"event_id": "int64", "store_id": "Int64"})

    def _keep(self, stored: tuple | None, rest: list) -> None:
        if stored is None:
            self.stored.clear()
        else:
            self.stored.update(stored)
        if rest:
            self.waiting.put([tuple(e) for e in rest])
            self._wake(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
            if stored is not None:
                self._wake((stored[0] + self.life) // 1000 + 1)

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, ttl: int = ANSWER_TTL, late: str = "10 minutes") -> DataFrame:
    """``(event_id, key, outcome, store_id)`` of each lookup, as ``operators.cache.outcomes`` gives them, for a stream of ``keyed`` events.

    Events may be ``late`` by as much as said; later ones are dropped. The session must keep state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), as Spark asks of this kind of state.
    """
    timed = events.select("event_id", "ts", "kind", "key", "open").withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(AnswerCache(ttl), OUT, "Append", "EventTime")
