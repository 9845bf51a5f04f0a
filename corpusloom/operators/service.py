"""What a running service leaves behind: latencies, throughput, cost, cached answers, sessions, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as X
from corpusloom.storage import stored

WINDOW_SECONDS, ANSWER_TTL, SESSION_TTL = 60, 3600, 86400
MAX_BODY_BYTES, MAX_QUESTION = 1 << 20, 2000
#: Bins of a key's values in one round of the search for a quantile.
BINS = 256


def quantiles(samples: DataFrame, by: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """``(by, p, q)``: exact interpolated quantiles of ``samples(by, value)``, by ever finer histograms. Null values don't count; a null key is one.

    A quantile lies between two neighbours in order. Each round counts the values of the interval that holds the lower one in
    ``BINS`` bins, summed in each task, and keeps the bin with it, until that has one value only; bins end at values that occur, so
    they shrink however values are spread. So a task sends a row per key and bin, and none holds or sorts a key's values.
    """
    rows = samples.select(F.col(by).alias("_key"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    sums = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    wanted = stored(sums.select("_key", F.explode(F.array(*map(F.lit, points))).alias("p"), "n", "low", "high").selectExpr("_key", "p", "(n - 1) * p as h", "low", "high", "0L as before"))
    while wanted.where("low < high").limit(1).count():
        inside = _between(rows, wanted)
        # Halves of the interval are worked out apart, so that it may be as wide as doubles get.
        width = F.col("high") / BINS - F.col("low") / BINS
        bin_ = F.when(width > 0, F.least(F.floor(F.col("_v") / width - F.col("low") / width), F.lit(BINS - 1))).otherwise(F.when(F.col("_v") > F.col("low"), 1).otherwise(0)).cast("int")
        counted = inside.groupBy("_key", "p", "h", "before", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("c").over(W.partitionBy("_key", "p").orderBy("bin")) + F.col("before")
        held = counted.withColumn("upto", upto).where("floor(h) >= upto - c and floor(h) < upto")
        wanted = stored(held.selectExpr("_key", "p", "h", "low", "high", "upto - c as before").unionByName(wanted.where("low >= high")))
    # The upper neighbour is the same value if there is another of it, else the least beyond.
    value_ = F.col("low")
    after = rows.join(F.broadcast(wanted.withColumnRenamed("_key", "_own")), F.col("_key").eqNullSafe(F.col("_own")) & (F.col("_v") >= value_))
    ends = after.groupBy("_key", "p", "h", "low", "before").agg(F.count_if(F.col("_v") == value_).alias("same"), F.min(F.when(F.col("_v") > value_, F.col("_v"))).alias("beyond"))
    share = F.col("h") - F.floor("h")
    upper = F.when(F.floor("h") + 1 < F.col("before") + F.col("same"), value_).otherwise(F.coalesce("beyond", value_))
    return ends.select(F.col("_key").alias(by), "p", (value_ + share * (upper - value_)).alias("q"))


def _between(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows within the open intervals of their key. There are as many intervals as keys and points; keys are few (labels of stages)."""
    open_ = wanted.where("low < high").withColumnRenamed("_key", "_own")
    return rows.join(F.broadcast(open_), F.col("_key").eqNullSafe(F.col("_own")) & F.col("_v").between(F.col("low"), F.col("high"))).drop("_own")


def stage_latency(samples: DataFrame, by: str = "stage") -> DataFrame:
    """Count, mean, extremes and exact interpolated percentiles in milliseconds of ``samples(by, seconds, tokens)``; negatives count as 0."""
    ms = F.greatest(F.col("seconds"), F.lit(0.0)) * 1000
    spent = F.sum(F.greatest(F.col("seconds"), F.lit(0.0)))
    sums = samples.groupBy(by).agg(
        F.count("*").alias("count"), F.round(F.avg(ms), 1).alias("avg_ms"), F.round(F.min(ms), 1).alias("min_ms"), F.round(F.max(ms), 1).alias("max_ms"),
        F.round(F.coalesce(F.try_divide(F.sum("tokens"), spent), F.lit(0.0)), 3).alias("tokens_per_s"),
    )
    found = quantiles(samples.select(F.col(by).alias("_by"), ms.alias("_ms")), "_by", "_ms", (0.5, 0.9, 0.99))
    points = found.groupBy("_by").agg(*(F.round(F.max(F.when(F.col("p") == p / 100, F.col("q"))), 1).alias(f"p{p}_ms") for p in (50, 90, 99)))
    return sums.join(points, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "count", "avg_ms", "min_ms", "max_ms", "p50_ms", "p90_ms", "p99_ms", "tokens_per_s")


def sliding_rate(events: DataFrame, by: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``events`` plus in_window and rate: how many events of ``by`` fell in the seconds up to each, ends included."""
    at, width = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    # An event counts in its own stretch of time and in the next; so a task holds two stretches of a key, not all of it.
    timed = events.withColumn("_at", at).withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_stretch", F.floor(F.col("_at") / width) + F.col("_ahead"))
    window = W.partitionBy(by, "_stretch").orderBy("_at").rangeBetween(-width, 0)
    counted = timed.withColumn("in_window", F.count("*").over(window)).where("_ahead = 0")
    return counted.withColumn("rate", F.round(F.col("in_window") / seconds, 3)).drop("_at", "_ahead", "_stretch")


def overall_rate(events: DataFrame, by: str) -> DataFrame:
    """Events per second between the first and the last of each key; of a single moment, 0."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.groupBy(by).agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(F.count("*"), F.max(at) - F.min(at)), F.lit(0.0)), 6).alias("qps"))


def cost_rollup(calls: DataFrame, by: tuple[str, str]) -> DataFrame:
    """Tokens and dollars of ``calls(by.., prompt_tokens, completion_tokens)`` by both keys, by the first, and in all."""
    sums = calls.rollup(*by).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return sums.withColumn("cost_usd", X.cost(F.col("prompt_tokens"), F.col("completion_tokens")))


def sessions(events: DataFrame, key: str = "user_id", ttl: int = SESSION_TTL) -> DataFrame:
    """``(key, session, start, end, n)``: a session ends when more than ``ttl`` seconds pass without an event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    order = W.partitionBy(key).orderBy("at", "event_id")
    timed = events.withColumn("at", at).withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(order) > ttl * 1_000_000, F.lit(True)))
    numbered = timed.withColumn("session", F.sum(F.col("new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def replay_cache(requests: DataFrame, key: str = "key", ttl: int = ANSWER_TTL) -> DataFrame:
    """``requests`` plus hit: whether an answer stored by an earlier miss was at most ``ttl`` seconds old. Hits renew nothing.

    Each entry's life hangs on the miss that stored it, so times are folded in order. After a pause of more than ``ttl`` no entry is
    left, so what is folded is one run of requests without such a pause, not all of a key. The state is the last store and the
    misses so far, which lie more than ``ttl`` apart; equal times are ordered by event_id.
    """
    at, order = F.unix_micros(F.col("ts").cast("timestamp")), W.partitionBy(key).orderBy("_at", "event_id")
    paused = F.coalesce(F.col("_at") - F.lag("_at").over(order) > ttl * 1_000_000, F.lit(True))
    runs = requests.withColumn("_at", at).withColumn("_paused", paused).withColumn("_run", F.sum(F.col("_paused").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    gathered = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col("event_id").cast("long").alias("event_id")))).alias("l"))
    start = F.struct(F.lit(None).cast("long").alias("stored"), F.array().cast("array<bigint>").alias("misses"))

    def step(state: Column, x: Column) -> Column:
        hit = F.coalesce(x["_at"] - state["stored"] <= ttl * 1_000_000, F.lit(False))
        return F.when(hit, state).otherwise(F.struct(x["_at"].alias("stored"), F.concat(state["misses"], F.array(x["event_id"])).alias("misses")))

    misses = gathered.select(F.col(key).alias("_key"), F.explode(F.aggregate("l", start, step, lambda s: s["misses"])).alias("_missed"))
    rows = requests.select(key, F.col("event_id").cast("long").alias("event_id"))
    return rows.join(misses, F.col(key).eqNullSafe(F.col("_key")) & (F.col("event_id") == F.col("_missed")), "left").select(key, "event_id", F.col("_missed").isNull().alias("hit"))


def check_request(body: Column) -> Column:
    """The status that a request body gets: 413 if too long, 400 if no JSON object or without a question of at most 2000 characters, else 200."""
    parsed = F.try_parse_json(body)
    question = F.coalesce(X.strip(F.get_json_object(body, "$.question")), F.lit(""))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    bad = ~is_object | (question == "") | (F.char_length(question) > MAX_QUESTION)
    return F.when(F.octet_length(body) > MAX_BODY_BYTES, 413).when(bad, 400).otherwise(200)


def counters(events: DataFrame, label: str) -> DataFrame:
    """Events by one low-cardinality label, with its share of all."""
    n = events.groupBy(label).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(label, "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def usage_totals(bodies: DataFrame, by: str, body: str = "body") -> DataFrame:
    """``(by, calls, prompt_tokens, completion_tokens, total_tokens)``: what the usage of each JSON body adds up to, 0 for what is no number.

    Numbers are cut to whole ones; text counts if it is a whole number.
    """
    parsed = bodies.select(F.col(by), F.try_parse_json(body).alias("_b"))

    def spent(name: str) -> Column:
        v = F.try_variant_get("_b", f"$.usage.{name}", "variant")
        kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
        text = F.trim(F.try_variant_get("_b", f"$.usage.{name}", "string"))
        whole = F.when(kind != "STRING", F.try_variant_get("_b", f"$.usage.{name}", "double").cast("long")).when(F.rlike(text, F.lit(r"^[+-]?\d+$")), text.try_cast("long"))
        return F.sum(F.coalesce(whole, F.lit(0).cast("long"))).alias(name)

    return parsed.groupBy(by).agg(F.count("*").alias("calls"), *map(spent, USAGE))
