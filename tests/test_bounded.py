"""Operators whose tasks hold a bounded part of a key or document, against plain loops; bounds are set low to be met."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.jobs import answer, grid
from corpusloom.operators import cleaning, intent, ranking, service, streams, vectors


def whole_fusion(queries, texts, base, k):
    """Rank every document in both lists, then fuse."""
    bags = {d: Counter(w for w in (t or "").lower().split()) for d, t in texts}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    out = {}
    for q, text, vector in queries:
        asked, lists = Counter((text or "").lower().split()), []
        said = [(-round(sum(m * idf[w] * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, m in asked.items() if b[w]), 6) + 0.0, d) for d, b in bags.items() if any(b[w] for w in asked)]
        lists.append({d: (i + 1, -s) for i, (s, d) in enumerate(sorted(said))})
        cos = lambda a, b: 0.0 if b is None or not any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
        lists.append({d: (i + 1, -s) for i, (s, d) in enumerate(sorted((-round(cos(vector, v), 6) + 0.0, d) for d, v in base))} if vector else {})
        fused = sorted((-round(sum(1 / (60 + x[d][0]) for x in lists if d in x), 9), d) for d in lists[0].keys() | lists[1].keys())[:k]
        out |= {(q, d): (i + 1, -s, *(round(x[d][1], 6) if d in x else None for x in lists)) for i, (s, d) in enumerate(fused)}
    return out


def test_fused_heads_equal_whole_rankings(spark, monkeypatch):
    """Ties, null texts and vectors, a question without words, more questions than a block holds, documents in many slices."""
    monkeypatch.setattr(ranking, "PAIRS", 300)
    monkeypatch.setattr(ranking.blocks, "__defaults__", (3,))
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(300, None), (301, "")]
    base = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(280)] + [(280, None), (900, [1.0, 0.0, 0.0])]
    queries = [(i, " ".join(rng.choice("a b c d z".split()) for _ in range(3)), [rng.random() - 0.5 for _ in range(3)]) for i in range(6)] + [(6, "q", [1.0, 2.0, 0.5]), (7, "a a b", None), (8, None, [0.0, 1.0, 0.0])]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = ranking.hybrid_top(df(queries, "query_id long, text string, vector array<double>"), df(texts, "doc_id long, text string"), df(base, "id long, vector array<double>"), 4)
    found = {(r["query_id"], r["idx"]): (r["rank"], r["rrf"], r["left_score"], r["right_score"]) for r in got.collect()}
    want = whole_fusion(queries, texts, base, 4)
    assert found.keys() == want.keys()
    for key, row in want.items():
        assert found[key] == pytest.approx(row, nan_ok=True), key


def test_common_words_are_summed_in_parts(monkeypatch):
    """A word that all questions have doesn't make arrays of all pairs at once, and parts of any size give the same scores."""
    asked, docs, n = 600, 400, 30
    words = [f"w{i}" for i in range(n)]
    scorer = ranking.Bm25(np.arange(asked), pa.array(words), np.arange(n + 1) * asked, np.tile(np.arange(asked), n), np.linspace(0.5, 2, n * asked), 20.0, 6)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(docs)), pa.array([words[: d % (n + 1)] * 2 for d in range(docs)], pa.list_(pa.string()))], ["id", "tokens"])
    tracemalloc.start()
    _, scores = scorer(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    assert np.isnan(scores[:, 0]).all() and not np.isnan(scores[:, 1]).any()
    monkeypatch.setattr(ranking, "SUMS", 1)
    np.testing.assert_array_equal(scorer(batch)[1], scores)


def test_grid_searches_each_list_once(spark, monkeypatch):
    """The rankers alone read the heads that the fusion reads."""
    calls, head = [], ranking.head
    monkeypatch.setattr(ranking, "head", lambda *a: calls.append(a) or head(*a))
    chunks = spark.createDataFrame([(i, f"a b{i % 3} c{i}", ["a", f"b{i % 3}", f"c{i}"], [1.0, float(i)]) for i in range(40)], "idx long, text string, tokens array<string>, vector array<double>")
    asked = spark.createDataFrame([(1, "a b1"), (2, "c7 a")], "query_id long, text string")
    got = grid.rankings(chunks, asked, lambda t: F.array(F.lit(1.0), F.char_length(t).cast("double")), 3, 20)
    assert Counter((r["ranker"], r["query_id"]) for r in got.collect()) == Counter({(r, q): 3 for r in grid.RANKERS for q in (1, 2)})
    assert len(calls) == 2


def test_heads_send_few_rows(spark):
    """Rows that leave a task don't grow with the documents."""
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.0, 1.0])], "query_id long, vector array<double>").toArrow()
    for n in (500, 4000):
        base = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("vector")).repartition(2)
        plan = ranking.head(base, ranking.cosine(asked, 6), 10)
        plan.collect()
        made = plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() == 20 and "MapInArrow" in made and "CartesianProduct" not in made and "BroadcastNestedLoopJoin" not in made


def greedy(rows):
    out, kept = {}, []
    for pos, v in sorted(rows):
        v = np.asarray(v) / (np.linalg.norm(v) or 1)
        near = [(round(float(np.dot(k, v)), 9), -p) for p, k in kept]
        s, p = max(near) if near else (None, None)
        verdict = "keep" if s is None or s < 0.85 else "review" if s < 0.9 else "drop"
        out[pos] = (verdict, None if p is None else -p, s)
        if verdict != "drop":
            kept.append((pos, v))
    return out


@pytest.mark.parametrize("block", [4, 7, 8192])
def test_leaders_of_long_documents(spark, block):
    """The rule's verdict is that of one walk, however many rounds a document takes."""
    rng = random.Random(6)
    docs = {1: 40, 2: 3, 3: 15, 4: 1}
    rows = [(d, p, [rng.choice([1.0, 1.0, 0.4, 0.0]), rng.choice([1.0, 0.5, 0.0]), rng.choice([0.0, 0.2, 1.0])]) for d, n in docs.items() for p in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, vector array<double>").repartition(3)
    got = vectors.greedy_unique(df, block=block)
    assert got.columns == ["doc_id", "pos", "verdict", "best", "sim"]
    by = defaultdict(dict)
    for r in got.collect():
        by[r["doc_id"]][r["pos"]] = (r["verdict"], r["best"], None if r["sim"] is None else pytest.approx(r["sim"], abs=1e-8))
    for d in docs:
        assert by[d] == greedy([(p, v) for x, p, v in rows if x == d])
    assert vectors.greedy_unique(df.where("false")).count() == 0


def test_texts_are_embedded_where_they_are(spark):
    """No vector is shuffled: neither by the embedding, nor by the search over texts, nor by the walk over units, which deals out texts."""
    texts = ["ab  c\u00a0é", "", None, " \t\n", "x" * 5, "漢字 𝒳y", "aab ab b"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = vectors.hash_embed(docs, 32)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = defaultdict(dict)
    for r in made.collect():
        got[r["doc_id"]][r["bucket"]] = r["weight"]
    for i, t in enumerate(texts):
        want = Counter()
        for w in re.split(r"\s+", t or ""):
            for f in [*w, *(w[j : j + 2] for j in range(len(w) - 1))]:
                want[zlib.crc32(f"0:{f}".encode()) % 32] += 1 if zlib.crc32(f"1:{f}".encode()) % 2 else -1
        norm = math.sqrt(sum(v * v for v in want.values()))
        assert got[i] == {b: pytest.approx(v / norm) for b, v in want.items() if v}
    base = docs.withColumnsRenamed({"doc_id": "id", "text": "vector"})
    near = vectors.cosine_top(base.where("id in (0, 1, 6)").withColumnRenamed("id", "query_id"), base, 3, embed=partial(vectors.hashed_rows, dim=32))
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in near.where("sim > 0.999999").collect()) == [(q, 1 + x, q % 7 + 7 * x) for q in (0, 6) for x in range(3)]
    assert near.where("query_id = 1 or id in (1, 2, 3)").isEmpty()
    units = docs.select(F.lit(1).cast("long").alias("doc_id"), F.col("doc_id").alias("pos"), F.col("text").alias("vector"))
    embed = partial(vectors.hashed_rows, dim=32)
    one, rounds = (sorted(map(tuple, vectors.greedy_unique(units, block=b, embed=embed).collect())) for b in (8192, 4))
    assert len(one) == 21 and one == rounds and {r[2] for r in one if r[1] >= 7 and (texts[r[1]] or "").strip()} == {"drop"}
    walked = vectors.greedy_unique(units, embed=embed)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in walked and all("array<" not in line for line in walked.splitlines() if "Exchange" in line)


def test_groups_stream_by():
    """Groups over many batches stay whole, and pairs of characters of a whole batch are found at once, as for each text alone."""
    rng = random.Random(3)
    keys = sorted((rng.randrange(4), rng.randrange(2)) for _ in range(60))
    rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(range(60))], ["a", "b", "n"])
    for size in (1, 7, 60):
        seen = []
        for table, at in streams.whole_groups(iter([rows.slice(i, size) for i in range(0, 60, size)] + [rows.slice(60)]), 2):
            seen += [table.slice(x, y - x).to_pydict() for x, y in pairwise([*at, len(table)])]
        assert [(g["a"][0], g["b"][0]) for g in seen] == sorted(set(keys)) and [n for g in seen for n in g["n"]] == list(range(60))
        assert all(len(set(zip(g["a"], g["b"], strict=True))) == 1 for g in seen)
    texts = ["abab", "a", "", "𝒳é𝒳é", "ba", "é", "aaaa"]
    unit, gram, size = cleaning.gram_cells(pa.array(texts))
    want = [{t[i : i + 2] for i in range(max(1, len(t) - 1))} if t else set() for t in texts]
    assert size.tolist() == [len(w) for w in want] == np.bincount(unit, minlength=len(texts)).tolist()
    of = [set(gram[unit == i].tolist()) for i in range(len(texts))]
    assert all(len(of[i] & of[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(len(texts)))


@pytest.mark.parametrize("block", [3, 2048])
def test_pairs_of_units(spark, block):
    rng = random.Random(8)
    rows = []
    for d in range(4):
        base = ["".join(rng.choice("abcdef") for _ in range(14)) for _ in range(4)]
        for p in range(20):
            u = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                u[rng.randrange(14)] = rng.choice("xyz")
            rows.append((d, p, 0, "".join(u)))
    df = cleaning.dedup_units(spark.createDataFrame(rows + [(9, 0, 0, "abcdefgh"), (8, 0, 0, None)], "doc_id long, pos long, seg int, unit string"))
    got = Counter(tuple(r) for r in cleaning.unit_pairs(df, block=block).collect())
    want = Counter()
    for d in range(4):
        units = list(dict.fromkeys(u for x, _, _, u in rows if x == d))
        grams = [{u[i : i + 2] for i in range(len(u) - 1)} for u in units]
        sims = [(round(len(grams[i] & grams[j]) / len(grams[i] | grams[j]), 3), len(grams[i] & grams[j]) / len(grams[i] | grams[j]), i, j) for i in range(len(units)) for j in range(i + 1, len(units))]
        weak = sorted((x for x in sims if 0.4 <= x[1] < 0.8), key=lambda x: (-x[0], x[2], x[3]))[:3]
        want.update((d, kind, units[i], units[j], s) for kind, some in (("fuzzy", [x for x in sims if x[1] >= 0.8]), ("weak", weak)) for s, _, i, j in some)
    assert got == want and len(want) > 12


def test_quantiles(spark):
    """Few and many values, ties, extremes, nulls, a null key."""
    rng = random.Random(2)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 50 + [2.0] * 3, "wide": [10.0**e for e in range(-300, 300, 7)] + [-(10.0**e) for e in range(0, 300, 11)], "many": [rng.lognormvariate(0, 6) for _ in range(3000)],
              None: [0.0, -0.0, 5.0], "close": [1 + i * 2**-52 for i in range(40)], "huge": [-1.7e308, 1.7e308, 0.0, 1.0]}
    rows = [(k, v) for k, g in groups.items() for v in g] + [("none", None), ("two", None)]
    got = {(r["k"], r["p"]): r["q"] for r in service.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)).collect()}
    want = {}
    for k, g in groups.items():
        for p in (0.0, 0.25, 0.5, 0.9, 0.99, 1.0):
            g = sorted(g)
            h = (len(g) - 1) * p
            low, high = g[math.floor(h)], g[min(math.floor(h) + 1, len(g) - 1)]
            want[k, p] = low + (h - math.floor(h)) * (high - low) if h > math.floor(h) else low
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key] == v or got[key] == pytest.approx(v, rel=1e-12), key


def test_variants_have_their_own_widths(spark):
    """A wide question gets more hits than a narrow one; a variant without hits is a row and stops nobody else's."""
    docs = spark.createDataFrame([(i, "f", "apple pear" if i % 2 else "apple plum") for i in range(60)], "doc_id long, file_name string, text string")
    raw = ['{"question_type":"summary"}', '{"question_type":"comparison","sub_queries":["pear","zzz"]}', "no json"]
    asked = spark.createDataFrame([(i, q, r) for i, (q, r) in enumerate(zip(("apple", "pear zzz", "plum"), raw, strict=True))], "query_id long, question string, raw string")
    questions = asked.select("query_id", "question", intent.normalize_intent(F.col("raw")).alias("intent"))
    rows = answer.variant_hits(questions, docs.select("doc_id", "text")).collect()
    got = Counter((r["query_id"], r["variant"], r["origin"], r["failed"]) for r in rows)
    assert got == {(0, 0, "direct", False): 30, (1, 0, "decompose", False): 12, (1, 1, "decompose", True): 1, (2, 0, "direct", False): 12}
    hits = answer.answered(questions, docs).collect()
    assert Counter(r["query_id"] for r in hits) == {0: 15, 1: 6, 2: 6}
    assert [r["idx"] for r in sorted((r for r in hits if r["query_id"] == 1), key=lambda r: r["final_rank"])] == [1, 3, 5, 7, 9, 11]
    made = answer.prompts(answer.answered(questions, docs), "rules").collect()
    assert {r["query_id"]: r["n_hits"] for r in made} == {0: 15, 1: 6, 2: 6} and all("【问题】" in r["messages"][1]["content"] for r in made)
