"""What retrieval tells about itself: histograms with fixed buckets, which merge, and counters observed while a job runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Upper ends of buckets, each inside its bucket.
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
MEASURES = ("hits", "top_score", "context_chars")


def bucket(value: Column, bounds: Sequence[float] = BOUNDS) -> Column:
    """The upper end of a value's bucket; infinity beyond the last, null for null and NaN."""
    ends = F.array(*(F.lit(float(b)) for b in bounds))
    least = F.array_min(F.filter(ends, lambda b: b >= value))
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.coalesce(least, F.lit(float("inf"))))


def histogram(rows: DataFrame, by: Sequence[str], measures: Sequence[str], bounds: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """``(*by, measure, le, n, total)`` of numeric columns: how many values fell in each bucket and their sum. Null values don't count.

    Counted in each task before the shuffle, so a hot label sends a row per bucket.
    """
    own = bounds or {}
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v"), bucket(F.col(m), own.get(m, BOUNDS)).alias("le")) for m in measures))
    long = rows.select(*by, F.explode(each).alias("x")).select(*by, "x.*").where("le is not null")
    return long.groupBy(*by, "measure", "le").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def merged(histograms: DataFrame) -> DataFrame:
    """Histograms of several runs as one; their bounds are the same."""
    keys = [c for c in histograms.columns if c not in ("n", "total")]
    return histograms.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def retrieval(asked: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``asked`` plus hits, top_score, context_chars and empty, by ``hits(*keys, score, text)``: a question without a hit has 0, null, 0 and true."""
    found = hits.groupBy(*keys).agg(F.count("*").alias("hits"), F.max("score").alias("top_score"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("context_chars"))
    none = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("hits", "context_chars")}
    return asked.join(found, list(keys), "left").withColumns(none).withColumn("empty", F.col("hits") == 0)


def _totals() -> tuple[Column, ...]:
    return (
        F.count("*").alias("asked"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count_if("empty").alias("empty"), F.max("top_score").alias("top_score"),
        F.coalesce(F.sum("context_chars"), F.lit(0)).alias("context_chars"),
    )


def observed(rows: DataFrame, by: Observation | str) -> DataFrame:
    """``rows`` of ``retrieval``, whose totals an ``Observation`` (or, in a stream, a ``Watch`` of that name) sees as they pass: no pass of its own."""
    return rows.observe(by, *_totals())


def totals(rows: DataFrame) -> DataFrame:
    """The same totals by a pass of their own, one row."""
    return rows.agg(*_totals())


class Watch(StreamingQueryListener):
    """Adds up what batches of streams observed under a name: sums, and the largest top_score."""

    def __init__(self, name: str) -> None:
        self.name, self.sums = name, {"asked": 0, "hits": 0, "empty": 0, "context_chars": 0}
        self.top_score: float | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        for c in self.sums:
            self.sums[c] += row[c] or 0
        self.top_score = max((s for s in (self.top_score, row["top_score"]) if s is not None), default=None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
