"""Rules on small hand-made rows, and sequential rules against plain restatements."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.jobs import index
from corpusloom.operators import chunking, cleaning, evaluation, fusion, intent, lexical, memory, service, vectors
from corpusloom.sources import files, html


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


def as_lines(spark, *lines):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos long, line string")


def texts(df, *order):
    return [r["line"] for r in df.orderBy(*(order or ("pos",))).collect()]


@pytest.mark.parametrize(("rule", "given", "want"), [
    (X.close_spaces, "签收后 7 天内 退 货", "签收后7天内退货"), (X.fix_typos, "7夭内联纱客服", "7天内联系客服"), (X.normalize_cell, "7日", "7天"), (X.normalize_cell, "7  天", "7天"),
    (X.normalize_query, "退货期限  多久？！", "退货期限 多久"), (X.has_reference, "那北京呢", True), (X.has_reference, "普通商品怎么退", False), (X.has_reference, None, False),
    (X.json_body, '```json {"a":1}```', '{"a":1}'), (X.json_body, "none", None), (X.normalize_unit, "ＡＢＣ１２３！", "abc123"), (X.is_list_item, " - a", True), (X.is_list_item, "- ", False),
    (X.is_heading, "三、退货", True), (X.ends_terminal, "甲，", True), (X.count_typos, "7夭 7夭 联纱", 3), (X.bigrams, "a", ["a"]), (X.bigrams, "", []), (X.split_sentences, "甲。 乙！丙", ["甲。", "乙！", "丙"]),
])
def test_scalar_rules(spark, rule, given, want):
    assert one(spark, rule, given) == want


def test_stable_hash_and_costs(spark):
    import zlib

    assert one(spark, lambda c: X.stable_hash(c, 0), "ab") == zlib.crc32(b"0:ab")
    assert spark.range(1).select(X.cost(F.lit(1000), F.lit(1000)).alias("x")).first()["x"] == 0.00137
    assert [r[0] for r in spark.createDataFrame([(401,), (429,), (500,), (404,)], "s int").select(X.http_error_kind(F.col("s"))).collect()] == ["auth", "rate_limit", "server", "bad_request"]
    assert spark.range(1).select(X.overlap_share(F.lit(0), F.lit(5), F.lit(3), F.lit(7)).alias("x")).first()["x"] == 0.5


def test_lists(spark):
    lines = as_lines(spark, "附件齐全", "(cid:127) 包装完整", "l 附件齐全", "附件齐全", "1、甲；2、乙。", "正文")
    assert texts(cleaning.normalize_lists(lines), "pos", "sub") == ["附件齐全", "- 包装完整", "- 附件齐全", "- 附件齐全", "- 甲", "- 乙", "正文"]


def test_joining(spark):
    assert texts(cleaning.join_broken(as_lines(spark, "标题", "转换为", "Markdown 文本。"))) == ["标题", "转换为 Markdown 文本。"]
    assert texts(cleaning.join_broken(as_lines(spark, "标题", "甲，", "乙。"))) == ["标题", "甲，", "乙。"]


def joined(lines):
    """The joining rule told line by line."""
    def special(s):
        import re

        s = s.strip()
        return not s or s.startswith(("|", "- ", "# ")) or re.match("备注[：:]", s) is not None

    out, last, title_at = [], None, None
    for i, s in enumerate(lines):
        plain = not special(s)
        if plain and title_at is None and not any(x.strip() for x in lines[:i]):
            title_at = i
        glued = last is not None and plain and not special(lines[i - 1]) and i - 1 != title_at and lines[i - 1][-1] not in X.TERMINAL_MARKS
        if glued:
            out[-1] += (" " if "一" <= out[-1][-1] <= "鿿" and s[0].isascii() and s[0].isalnum() else "") + s
        else:
            out.append(s)
        last = s
    return out


def test_joining_at_random(spark):
    rng = random.Random(5)
    docs = [[rng.choice(["甲", "ab", "乙。", "- x", "", "# h", "备注：y", "丙，", "| a |", "c9"]) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    df = spark.createDataFrame([(d, i, s) for d, x in enumerate(docs) for i, s in enumerate(x)], "doc_id long, pos long, line string")
    got: dict[int, list[str]] = {}
    for r in cleaning.join_broken(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["line"])
    assert got == {d: joined(x) for d, x in enumerate(docs)}


def test_line_and_sentence_dedup(spark):
    assert texts(cleaning.dedup_within(as_lines(spark, "- 甲", "甲", "", "乙"))) == ["- 甲", "", "乙"]
    assert texts(cleaning.compact_blanks(as_lines(spark, "", "甲", "", "", "乙", ""))) == ["甲", "", "乙"]
    assert texts(cleaning.dedup_sentences(as_lines(spark, "短句。短句。"))) == ["短句。短句。"]
    assert texts(cleaning.dedup_sentences(as_lines(spark, "这是一个很长的句子。尾", "这是一个很长的句子。"))) == ["这是一个很长的句子。尾"]


def test_near_duplicate_units(spark):
    rows = spark.createDataFrame([(1, 0, 0, "ＡＢＣ１２３！"), (1, 1, 0, "abc123"), (1, 2, 0, "abc1234"), (2, 0, 0, "abc123")], "doc_id long, pos long, seg int, unit string")
    kept = cleaning.dedup_units(rows)
    assert kept.count() == 3
    assert [(r["a"], r["b"], r["sim"]) for r in cleaning.similar_units(kept, 0.8).collect()] == [("abc123", "abc1234", 0.833)]


def test_noise_and_whole_cleaning(spark):
    kept, audit = cleaning.drop_noise(as_lines(spark, "XX商城售后服务中心 | 客户服务部内部资料", "【异常数据 3】x", "﻿ 正文 ", "#####"))
    assert texts(kept) == ["正文"]
    assert audit.groupBy("rule").count().count() == 2
    docs = spark.createDataFrame([(1, "标题\n第一句很长很长很长。\n第一句很长很长很长。\n\n\n- 甲\n甲\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in cleaning.clean(docs).collect()] == [(1, "标题\n第一句很长很长很长。\n\n- 甲")]
    assert [(r["doc_id"], r["text"]) for r in cleaning.clean(cleaning.clean(docs)).collect()] == [(1, "标题\n第一句很长很长很长。\n\n- 甲")]


def test_tables(spark):
    lines = as_lines(spark, "| 商品 | | 期限 |", "|---|---|---|", "| 鞋 | | 7日 |", "| 鞋 | | 8日 |", "文", "| 商品 | 期限 |", "|---|---|", "| 鞋 | 7天 |", "| 帽 | 3 天 |", "尾", "| 单行 |")
    assert texts(cleaning.clean_tables(lines), "pos", "sub") == ["| 商品 | 期限 |", "| --- | --- |", "| 鞋 | 7天 |", "文", "| 帽 | 3天 |", "尾", "| 单行 |"]


def packed(spans, target, overlap):
    out, i = [], 0
    while i < len(spans):
        j = i
        while j + 1 < len(spans) and spans[j + 1][1] - spans[i][0] <= target:
            j += 1
        out.append((spans[i][0], spans[j][1]))
        if j == len(spans) - 1:
            break
        k = j
        while overlap and k > i and spans[k][0] > spans[j][1] - overlap:
            k -= 1
        i = max(k, i + 1) if overlap else j + 1
    return out


def test_chunk_rules():
    rng = random.Random(3)
    for _ in range(500):
        spans, at = [], 0
        for _ in range(rng.randint(0, 12)):
            at += rng.randint(0, 3)
            spans.append((at, at := at + rng.randint(1, 40)))
        for overlap in (0, 10, 30):
            assert chunking.merged(spans, 50, overlap) == packed(spans, 50, overlap)
    assert chunking.atoms("# a\nb\n\nc\n  \nd\n二、e\n") == [(0, 5), (7, 8), (12, 13), (14, 17)]
    text = "一二三。四五六七八九十"
    assert chunking.split_long(text, [(0, 11)], 5) == [(0, 4), (4, 9), (9, 11)]
    assert [text[a:b] for a, b in chunking.windows(text, 6, 2)] == ["一二三。", "三。四五六七", "六七八九十"]
    assert len(chunking.windows("a" * 50, 5, 9)) == 46
    whole = "甲乙\n\n" * 300
    for spans in (chunking.merged(chunking.atoms(whole), 50, 10), chunking.windows(whole, 50, 5)):
        seen = {i for a, b in spans for i in range(a, b)}
        assert all(i in seen for i, c in enumerate(whole) if c.strip())


def test_bm25_restated(spark):
    import math
    from collections import Counter

    corpus = {1: "a b a c", 2: "b c", 3: "d d d e", 4: ""}
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(9, "a b b z")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lexical.bm25(asked, lexical.postings(docs), lexical.lengths(docs)).collect()}
    bags = {k: Counter(v.split()) for k, v in corpus.items()}
    df = Counter(t for b in bags.values() for t in b)
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    mean = sum(sum(b.values()) for b in bags.values()) / 4
    for d, b in bags.items():
        want = sum(idf.get(t, 0) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in "a b b z".split() if b[t])
        assert got.get(d, 0) == pytest.approx(want)


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "ab c"), (2, "ab c"), (3, "xyz"), (4, None)], "doc_id long, text string")
    made = vectors.dense(vectors.hash_embed(docs, 64), 64)
    rows = {r["id"]: r["vector"] for r in made.collect()}
    assert set(rows) == {1, 2, 3} and rows[1] == rows[2] and sum(x * x for x in rows[1]) == pytest.approx(1)
    best = vectors.cosine_top(made.where("id = 1").withColumnRenamed("id", "query_id"), made, 2).orderBy("rank").collect()
    assert [(r["id"], round(r["sim"], 6)) for r in best] == [(1, 1.0), (2, 1.0)]
    units = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.05]), (1, 2, [0.0, 1.0]), (1, 3, [0.87, 0.5])], "doc_id long, pos long, vector array<double>")
    assert [(r["verdict"], r["best"]) for r in vectors.greedy_unique(units).orderBy("pos").collect()] == [("keep", None), ("drop", 0), ("keep", 0), ("review", 0)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1, 3.0), (1, 11, 2, 2.0)], "query_id long, idx long, rank long, score double")
    b = spark.createDataFrame([(1, 11, 1, 0.9), (1, 12, 2, 0.8)], "query_id long, idx long, rank long, score double")
    got = {r["idx"]: r["rrf"] for r in fusion.reciprocal_rank(a, b).collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61, 12: 1 / 62})
    k, fetch = fusion.widths(F.col("s"))
    assert [tuple(r) for r in spark.createDataFrame([(2.5,), (0.75,), (0.01,)], "s double").select(k, fetch).collect()] == [(15, 30), (4, 8), (1, 5)]
    asked = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "query_id long, index int")
    body = spark.createDataFrame([(1, '{"results":[{"index":0,"relevance_score":0.5},{"index":2,"relevance_score":0.1}]}')], "query_id long, body string")
    assert [r["score"] for r in fusion.scored_response(asked, body).orderBy("index").collect()] == [0.5, 0.0, 0.1]


def test_intents(spark):
    asked = ["退货期限多久", "什么是七天无理由", "快递丢了怎么办", "需要发票吗？", "这个呢", "两个套餐的区别", "你好", ""]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").orderBy("i")
    assert [r[0] for r in df.select(intent.rule_type(F.col("q"))).collect()] == ["fact", "definition", "troubleshooting", "fact", None, None, None, None]
    raw = ['{"question_type":"Summary","slots":[{"type":"region","value":" "}],"recall_scale":-1}', "junk", '{"strategies":["direct","clarify","x"]}']
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(intent.normalize_intent(F.col("r")).alias("i")).select("i.*").collect()
    assert [(r["question_type"], list(r["strategies"]), r["recall_scale"], len(r["slots"])) for r in got] == [("summary", ["direct"], 2.5, 0), ("fact", ["direct"], 1.0, 0), ("fact", ["clarify"], 1.0, 0)]
    line = spark.createDataFrame([(raw[0],)], "r string").select(intent.describe(intent.normalize_intent(F.col("r"))).alias("x")).first()["x"]
    assert line == "类型：总结（summary）\n策略：直接检索\n召回倍数：2.5"


def folded(n, keep=8, threshold=12):
    held = gone = 0
    for _ in range(n // 2):
        held += 2
        if held > threshold:
            gone, held = gone + held - keep, keep
    return gone


def test_memory(spark):
    for sizes, kept in (([1000] * 3, 2), ([3000], 1), ([10] * 9, 8)):
        turns = spark.createDataFrame([(1, i, "user", "x" * n) for i, n in enumerate(sizes)], "conv_id long, turn long, role string, text string")
        assert memory.recent_window(turns).count() == kept
    turns = spark.createDataFrame([(n, i, "user", "x") for n in range(1, 41) for i in range(n)], "conv_id long, turn long, role string, text string")
    for keep, threshold in ((8, 12), (4, 6)):
        got = {r["conv_id"]: r["folded"] for r in memory.fold(turns, keep, threshold).select("conv_id", "folded").distinct().collect()}
        assert got == {n: folded(n, keep, threshold) for n in range(1, 41)}


def test_service(spark):
    rows = spark.createDataFrame([("a", float(x), 10) for x in (1, 2, 3, 4)], "stage string, seconds double, tokens int")
    r = service.stage_latency(rows).first()
    assert (r["p50_ms"], r["p90_ms"], r["tokens_per_s"]) == (2500.0, 3700.0, 4.0)
    asked = [(0, 0), (1, 100), (2, 3600), (3, 3601), (4, 7300)]
    df = spark.createDataFrame([("k", e, t) for e, t in asked], "key string, event_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r["hit"] for r in service.replay_cache(df).orderBy("event_id").collect()] == [False, True, True, False, False]
    bodies = ['{"question":"x"}', "[1]", "{", '{"question":" "}', '{"question":"' + "y" * 2001 + '"}', "z" * (1 << 20) + "zz"]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(service.check_request(F.col("b"))).collect()] == [200, 400, 400, 400, 400, 413]


def test_evaluation(spark):
    docs = spark.createDataFrame([(1, "aaaa b")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, 0, 1, "aa")], "query_id long, passage_id int, doc_id long, passage string")
    spans = evaluation.gold_spans(asked, docs)
    assert sorted((r["gs"], r["ge"]) for r in spans.collect()) == [(0, 2), (1, 3), (2, 4)]
    ranked = spark.createDataFrame([(7, 5, 1), (7, 6, 2), (8, 5, 1)], "query_id long, idx long, rank long")
    relevance = spark.createDataFrame([(7, 6), (7, 9)], "query_id long, idx long")
    got = {r["k"]: r for r in evaluation.metrics(ranked, relevance, ranked.select("query_id").distinct(), ["idx"]).collect()}
    assert (got[1]["hit"], got[3]["hit"], got[3]["mrr"], got[3]["recall"]) == (0.0, 0.5, 0.25, 0.5)
    said = spark.createDataFrame([('x {"faithful": true, "correct": false} y',), ("nothing",)], "answer string").select(evaluation.judge_answer().alias("j")).select("j.*").collect()
    assert (said[0]["faithful"], said[0]["correct"], said[1]["faithful"], said[1]["hallucination"]) == (True, False, None, "nothing")


def test_sources_and_index(spark, tmp_path):
    for name, body in (("a.md", "# 甲\n退货期限是七天。\n\n# 乙\n运费由买家承担。"), (".hid/b.md", "x"), ("dirty_raw_c.md", "x"), ("sub/d.md", "# 丙\n发票可以补开。")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(body, encoding="utf-8")
    docs = files.markdown(spark, str(tmp_path / "in"))
    assert sorted(r["path"] for r in docs.collect()) == ["a.md", "sub/d.md"]
    assert files.fingerprint(docs).first() == files.fingerprint(docs.orderBy(F.desc("path"))).first()
    numbered = docs.select(F.xxhash64("path").alias("doc_id"), "text")
    cut = chunking.structure(400)
    mark = index.build(numbered, str(tmp_path / "index"), cut)
    assert index.build(numbered, str(tmp_path / "index"), cut) == mark
    hits = index.retrieve(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "退货期限是七天。")], "query_id long, text string"), k=2)
    assert hits.where("rank = 1").first()["text"].startswith("# 甲")
    assert "# T\n" in spark.createDataFrame([("<h1>T</h1><p>a &amp; b</p>",)], "h string").select(html.markdown(F.col("h")).alias("x")).first()["x"]
    stream = [(1, 0, 'data: {"choices":[{"delta":{"content":"a"}}]}'), (1, 1, "data: {bad"), (1, 2, "data: [DONE]"), (1, 3, 'data: {"choices":[{"delta":{"content":"b"}}]}')]
    assert [r["content"] for r in files.chat_deltas(spark.createDataFrame(stream, "request_id long, seq long, line string")).collect()] == ["a"]


def test_strategy_grid(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i} {k} about topic{i * 100 + k} and more words here" for k in range(30))) for i in range(4)], "doc_id long, text string")
    passages = docs.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("passage_id"), "doc_id", F.split("text", "\n")[9].alias("passage"))
    asked = passages.select("query_id", F.col("passage").alias("text"))
    cuts = {k: v for k, v in chunking.strategies("line").items() if k in ("full_doc", "merge_400_o20")}
    got = {(r["strategy"], r["k"]): r for r in index.evaluate(docs, passages, asked, cuts).collect()}
    assert len(got) == 6 and got["full_doc", 1]["hit"] == 1.0 and got["merge_400_o20", 5]["recall"] == 1.0 and got["merge_400_o20", 1]["hit"] == 1.0


def test_variants_messages_and_sets(spark):
    raw = '{"strategies":["decompose","direct"],"sub_queries":["a"," a ","b",""],"rewritten_query":"c"}'
    df = spark.createDataFrame([(1, "q", raw)], "query_id long, question string, raw string").withColumn("intent", intent.normalize_intent(F.col("raw")))
    assert [(r["text"], r["origin"]) for r in intent.variants(df).orderBy("variant").collect()] == [("a", "decompose"), ("b", "decompose"), ("c", "direct")]
    assert df.select(intent.questions_back(F.col("intent")).alias("x")).first()["x"] is None
    m = spark.range(1).select(memory.messages("s", F.lit("c"), F.lit("q"), F.lit(None).cast("string"), F.lit("r")).alias("m")).first()["m"]
    assert [x["role"] for x in m] == ["system", "user"] and "摘要" not in m[1]["content"] and m[1]["content"].endswith("q")
    made = spark.createDataFrame([(1, "u", "r", ["p"]), (100, "u", "r", ["p"])], "seq int, user_input string, reference string, reference_contexts array<string>")
    assert [r["id"] for r in files.test_set(made).orderBy("id").collect()] == ["q01", "q100"]
    rows = spark.createDataFrame([("a", "0.5"), ("b", None), ("c", "x"), ("d", "0.1")], "id string, m string")
    assert [r["id"] for r in evaluation.worst(rows, "m", n=3).collect()] == ["d", "a", "b"]
