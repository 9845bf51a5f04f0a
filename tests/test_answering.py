"""Cache gating, routes to stored answers, instruments, resumable parts, table functions and answer streams."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusloom import queries as q
from corpusloom.functions import tables
from corpusloom.functions import text as X
from corpusloom.jobs import batches
from corpusloom.operators import cache, chunking, fusion, instruments, intent, memory, service
from corpusloom.streaming import answers as answer_stream
from corpusloom.streaming import cache as cache_stream
from tests.conftest import DATA
from tests.test_queries import rows
from tests.test_streaming import drain

START = datetime(2024, 5, 1, tzinfo=UTC)
EVENT = "event_id long, ts timestamp, kind string, question string, answer string"


def cache_rows(n=400, seed=5):
    draw, rows = random.Random(seed), []
    for i in range(n):
        kind = cache.STORE if draw.random() < 0.3 else cache.LOOKUP
        question = draw.choice(["how long?", "How  long", "where", "and this", None, ""])
        rows.append((i, START + timedelta(seconds=draw.randrange(0, 4000)), kind, question, draw.choice(["yes", "yes", "", None])))
    return rows


def plain_cache(rows, ttl):
    stored, out = {}, set()
    for i, at, kind, question, answer in sorted(rows, key=lambda r: (r[1], r[0])):
        key = " ".join((question or "").lower().split()).rstrip("？?。！!，,、；;：:")
        if kind == cache.STORE:
            if answer and ttl > 0:
                stored[key] = (at, i)
        elif ttl <= 0 or "this" in (question or ""):
            out.add((i, cache.BYPASS, None))
        elif key in stored and (at - stored[key][0]).total_seconds() <= ttl:
            out.add((i, cache.HIT, stored[key][1]))
        else:
            out.add((i, cache.MISS, None))
    return out


def keyed(spark, rows, ttl):
    return cache.keyed(spark.createDataFrame(rows, EVENT), F.lit("f" * 40), ("this",), (), ttl)


def found(df):
    return {(r["event_id"], r["outcome"], r["store_id"]) for r in df.collect()}


@pytest.mark.parametrize("ttl", [0, 7, 300, 100_000])
def test_cache_equals_plain_replay(spark, ttl):
    """Ties in time, unanswered stores, null and leaning questions, and a cache that is off."""
    rows = cache_rows()
    rows += [(1000 + i, rows[0][1], cache.STORE if i % 2 else cache.LOOKUP, "where", "yes") for i in range(4)]
    got = found(cache.outcomes(keyed(spark, rows, ttl), ttl))
    assert got == plain_cache(rows, ttl)
    counts = cache.rates(cache.outcomes(keyed(spark, rows, ttl), ttl)).first()
    assert counts["lookups"] == len(got) == counts["hits"] + counts["misses"] + counts["bypasses"]


def test_cache_of_nothing(spark):
    assert cache.outcomes(keyed(spark, [], 60), 60).isEmpty()
    assert cache.rates(cache.outcomes(keyed(spark, [], 60), 60)).first()["hit_rate"] == 0.0


def test_cache_stream_equals_batch_on_late_input(spark, tmp_path):
    """Events come shuffled, some after their turn but within what the watermark allows; the outcome is that of the batch."""
    rows, ttl = cache_rows(120, 9), 300
    end = [(10_000 + i, START + timedelta(days=2 + i), cache.LOOKUP, "end", None) for i in range(2)]
    batch = keyed(spark, rows, ttl)
    random.Random(3).shuffle(rows)
    parts = [rows[:60], rows[60:], end[:1], end[1:]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate(parts):
            keyed(spark, part, ttl).coalesce(1).write.mode("append").option("compression", "none").parquet(str(tmp_path / f"e/{i}"))
        source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "e"))
        got = found(drain(cache_stream.outcomes(source, ttl, "2 hours")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {g for g in got if g[0] < 10_000} == found(cache.outcomes(batch, ttl))


def test_routes(spark):
    turns = [(1, 0, "user", "what is it"), (1, 1, "assistant", None), (1, 2, "user", "and more"), (2, 0, "user", "and more"), (2, 1, "user", None), (3, 0, "user", "lost")]
    asked = intent.with_history(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    history = {(r["conv_id"], r["turn"]): r["history"] for r in asked.collect()}
    assert history == {(1, 0): "", (1, 2): "用户：what is it\n助手：", (2, 0): "", (2, 1): "用户：and more", (3, 0): ""}
    raw = {(1, 2): '{"question_type":"Summary","completed_query":" more of it "}', (2, 0): '{"completed_query":"unused","question_type":"policy"}', (2, 1): "not json", (3, 0): None}
    answers = spark.createDataFrame([(c, t, v) for (c, t), v in raw.items()], "conv_id long, turn long, raw string")
    stored = asked.join(answers, ["conv_id", "turn"]).select(intent.call_key(F.col("question"), F.col("history")).alias("key"), "raw")
    out = intent.routed(asked, stored, F.when(F.contains("question", F.lit("what")), "definition"))
    got = {(r["conv_id"], r["turn"]): (r["route"], r["completed"], r["intent"]["question_type"], r["intent"]["recall_scale"], r["calls"], r["saved"]) for r in out.collect()}
    assert got == {
        (1, 0): ("rule", "what is it", "definition", 1.0, 0, 1), (1, 2): ("merged", "more of it", "summary", 2.5, 1, 1), (2, 0): ("plain", "and more", "policy", 1.5, 1, 0),
        (2, 1): ("fallback", "", "fact", 1.0, 1, 1), (3, 0): ("fallback", "lost", "fact", 1.0, 1, 0),
    }
    told = {r["route"]: r["d"] for r in out.select("route", intent.describe(F.col("intent"), F.col("route") == "rule").alias("d")).collect()}
    assert "规则判定" in told["rule"] and "规则判定" not in told["plain"]
    assert intent.routed(asked.limit(0), stored, F.lit("fact")).isEmpty()


@pytest.mark.parametrize("name", ["intent_routes", "model_calls"])
def test_routes_of_repeated_conversations(spark, tmp_path, name):
    """Conversations that say the same under other ids keep the answers of their own."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE conversations AS SELECT * REPLACE (conv_id + 1000003 * i AS conv_id) FROM '{DATA}/conversations.parquet', range(6) r(i)")
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    got, want = q.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(q.ORACLES[name]).df()
    assert rows(got) == rows(want)


def test_json_hint(spark):
    rows = [(0, [("system", "be brief"), ("user", "hi")]), (1, [("user", "hi")]), (2, [("user", "as JSON")]), (3, []), (4, [("system", None)])]
    df = spark.createDataFrame(rows, "i long, m array<struct<role:string,content:string>>")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", memory.json_hint(F.col("m"), "JSON!").alias("m")).collect()}
    assert got == {0: [("system", "be brief\nJSON!"), ("user", "hi")], 1: [("system", "JSON!"), ("user", "hi")], 2: [("user", "as JSON")], 3: [("system", "JSON!")], 4: [("system", "\nJSON!")]}


def test_usage_totals(spark):
    usage = [{"prompt_tokens": 3, "completion_tokens": "4", "total_tokens": 7.9}, {"prompt_tokens": "x", "completion_tokens": None, "total_tokens": " 2 "}, {"prompt_tokens": True, "total_tokens": "2.5"}]
    rows = [("a", json.dumps({"usage": u})) for u in usage] + [("a", "broken"), ("a", None), (None, '{"usage": 5}')]
    got = {r["k"]: tuple(r)[1:] for r in service.usage_totals(spark.createDataFrame(rows, "k string, body string"), "k").collect()}
    assert got == {"a": (5, 4, 4, 9), None: (1, 0, 0, 0)}


def test_instruments(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "q long, origin string")
    hits = spark.createDataFrame([(1, 5.0, "abcdef"), (1, 7.5, None), (3, 20000.0, "x" * 30)], "q long, score double, text string")
    per = instruments.retrieval(asked, hits, ["q"])
    assert {tuple(r) for r in per.select("q", "hits", "top_score", "context_chars", "empty").collect()} == {(1, 2, 7.5, 6, False), (2, 0, None, 0, True), (3, 1, 20000.0, 30, False)}
    drawn = instruments.histogram(per, ["origin"], instruments.MEASURES)
    got = {(r["origin"], r["measure"], r["le"]): (r["n"], r["total"]) for r in drawn.collect()}
    assert got == {
        ("a", "hits", 0.0): (1, 0.0), ("a", "hits", 5.0): (1, 2.0), ("b", "hits", 5.0): (1, 1.0), ("a", "top_score", 10.0): (1, 7.5), ("b", "top_score", float("inf")): (1, 20000.0),
        ("a", "context_chars", 10.0): (1, 6.0), ("a", "context_chars", 0.0): (1, 0.0), ("b", "context_chars", 50.0): (1, 30.0),
    }
    double = instruments.merged(drawn.unionByName(drawn))
    assert {(r["origin"], r["measure"], r["le"]): (r["n"], r["total"]) for r in double.collect()} == {k: (2 * n, 2 * t) for k, (n, t) in got.items()}
    seen = Observation("retrieval")
    instruments.observed(per, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == instruments.totals(per).first().asDict() == {"asked": 3, "hits": 3, "empty": 1, "top_score": 20000.0, "context_chars": 36}


def test_watch_adds_up_batches(spark, tmp_path):
    rows = [(1, 2, 7.5, 6, False), (2, 0, None, 0, True), (3, 1, 9.0, 30, False)]
    schema = "q long, hits long, top_score double, context_chars long, empty boolean"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    watch = instruments.Watch("retrieval")
    spark.streams.addListener(watch)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        drain(instruments.observed(source, "retrieval"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(watch)
    assert (watch.sums, watch.top_score) == ({"asked": 3, "hits": 3, "empty": 1, "context_chars": 36}, 9.0)


def test_killed_run_resumes(spark, tmp_path):
    """A run that dies leaves its finished parts; changed items, missing rows and missing notes are made anew, nothing else."""
    path, calls = f"file://{tmp_path}/batch", []
    items = spark.range(200).select("id", (F.col("id") * 2).alias("v"))

    def work(df, most=99):
        if not df.schema.fieldNames() or df.isEmpty():
            return df.select("id", (F.col("v") + 1).alias("w"))
        if len(calls) >= most:
            raise RuntimeError("killed")
        calls.append(df.count())
        return df.select("id", (F.col("v") + 1).alias("w"))

    def run(df, most=99):
        calls.clear()
        return sorted((r["id"], r["w"]) for r in batches.resumed(df, "id", lambda x: work(x, most), path, 8).collect())

    want = [(i, 2 * i + 1) for i in range(200)]
    with pytest.raises(RuntimeError):
        run(items, 3)
    assert run(items) == want and len(calls) == 5
    assert run(items) == want and calls == []
    changed = items.withColumn("v", F.when(F.col("id") == 7, -1).otherwise(F.col("v")))
    assert run(changed) == [(i, 0 if i == 7 else w) for i, w in want] and len(calls) == 1
    noted = {r["part"]: r["n"] for r in batches.notes(spark, path).collect()}
    assert sum(noted.values()) == 200 and len(noted) == 8
    spark.createDataFrame([(1, 1)], "id long, w long").write.mode("append").parquet(f"{path}/rows/part=2")
    assert run(changed) == [(i, 0 if i == 7 else w) for i, w in want] and len(calls) == 1
    assert run(items.limit(0)) == []


def test_table_functions_cut_as_columns_do(spark):
    tables.register(spark)
    texts = [(0, None), (1, ""), (2, "# A\none two\n\nthree\nfour five six\n" * 9), (3, "x" * 700), (4, "line\n" * 200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    ways = {"chunk_merge(text, 100, 20, 'structure')": chunking._spans(lambda t: chunking.merged(chunking.atoms(t), 100, 20)), "chunk_structure(text, 60, 'line')": chunking.structure(60, "line"), "chunk_window(text, 90, 9)": chunking.window(90, 0.1)}
    for call, cut in ways.items():
        got = spark.sql(f"SELECT doc_id, chunk, start, end, chunk_text FROM {{docs}}, LATERAL {call}", docs=docs)
        want = chunking.chunks(docs, cut)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() > 3


def test_public_hits(spark):
    df = spark.createDataFrame([(1, 2, None)], "query_id long, idx long, text string")
    assert fusion.public(df).first().asDict() == {"query_id": 1, "idx": 2, "file": "", "text": "", "snippet": "", "rerank": None, "rrf": None, "vec_sim": None, "bm25": None, "origins": []}


def test_answer_stream_repeats_leave_nothing_double(spark, tmp_path):
    docs = spark.createDataFrame([(i, "f", f"apple pear {i}") for i in range(9)], "doc_id long, file_name string, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "zzz")], "query_id long, question string")
    asked.coalesce(1).write.parquet(str(tmp_path / "q"))
    source = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "q")).withColumn("intent", intent.normalize_intent(F.lit("{}")))
    out = f"file://{tmp_path}/out"
    started = answer_stream.answers(source, docs, out, f"file://{tmp_path}/check", "rules", 2).start()
    try:
        started.processAllAvailable()
    finally:
        started.stop()

    def written():
        rows = spark.read.parquet(f"{out}/frames").orderBy("request_id", "seq").collect()
        return [(r["request_id"], r["seq"], json.loads(r["frame"].removeprefix("data: "))) for r in rows]

    once = written()
    assert [(q, s, e["type"]) for q, s, e in once] == [(1, 0, "sources"), (1, 1, "done"), (2, 0, "sources"), (2, 1, "done")]
    assert [h["idx"] for h in once[0][2]["hits"]] == [0, 1] and once[2][2]["hits"] == []
    answer_stream.write_batch(asked.withColumn("intent", intent.normalize_intent(F.lit("{}"))), docs, out, 0, "rules", 2)
    assert written() == once
    assert spark.read.parquet(f"{out}/messages").select("query_id").collect()[0]["query_id"] == 1


def test_cache_key_ends_marks(spark):
    row = spark.range(1).select((X.cache_key(F.lit("How  long?"), F.lit("f" * 40)) == X.cache_key(F.lit(" how long"), F.lit("f" * 40))).alias("same")).first()
    assert row["same"]
