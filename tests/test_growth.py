"""Work and memory of a task that must not grow with the input; bounds are set low to be met."""

from __future__ import annotations

import random
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import queries as q
from corpusloom.functions import text as X
from corpusloom.jobs import grid
from corpusloom.operators import chunking, cleaning, lexical, ranking
from tests.conftest import DATA


def test_cleaning_deals_documents_by_bytes(spark, monkeypatch):
    """Stages of few sorts, over partitions that grow in number with the text; any number of them gives the same texts."""
    rows = q.clean_pages(spark, DATA)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 8
    want = sorted(rows.collect())
    monkeypatch.setattr(cleaning, "DEAL", 20_000)
    dealt = q.clean_pages(spark, DATA)
    size = sum(len(r["text"]) for r in want)
    assert dealt.rdd.getNumPartitions() > max(4, size // 40_000)
    assert sorted(dealt.collect()) == want


def test_bm25_heads_are_made_without_rows_for_pairs(spark, monkeypatch):
    """The k best of each question leave a task, and no join or sum by question and document is in the plan; the rows are those of all pairs."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 9)))) for i in range(200)] + [(200, None), (201, "")]
    asked = [(1, "a b b"), (2, "zz"), (3, None), (4, "h"), (4, "a")]
    docs, questions = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    found = ranking.bm25_top(questions, docs, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "HashAggregate" not in plan
    want = lexical.top(lexical.bm25_of(questions, docs).withColumn("score", F.round("score", 6)), 5)
    rows = sorted((r["query_id"], r["idx"], r["score"], r["rank"]) for r in found.collect())
    assert rows == sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in want.collect())
    assert {r[0] for r in rows} == {1, 4}


def test_statistics_of_small_parts(spark, monkeypatch):
    """One pass counts documents, words and the documents of each term; parts of any size give the same."""
    texts = [(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None), (5, ["c", "b", "é"])]
    cut = spark.createDataFrame(texts, "doc_id long, tokens array<string>").coalesce(1)
    terms, mean = ranking.statistics(cut)
    want = lexical.inverse_frequencies(cut.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), spark.createDataFrame([(5,)], "n long"))
    assert sorted(terms.collect()) == sorted(want.collect()) and mean == 7 / 4
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts], pa.list_(pa.string()))], ["tokens"])
    monkeypatch.setattr(ranking, "SUMS", 2)
    monkeypatch.setattr(ranking, "TERMS", 2)
    rows = [r for b in ranking._frequencies(iter([batch, batch])) for r in b.to_pylist()]
    found = Counter()
    for r in rows:
        found[r["term"]] += r["df"] or 0
    assert found == Counter({"a": 4, "b": 4, "c": 2, "é": 2, None: 0})
    assert [(r["docs"], r["counted"], r["words"]) for r in rows if r["term"] is None] == [(10, 8, 14)]
    assert ranking.statistics(cut.where("false"))[1] == 1.0


def test_characters_are_counted_where_the_text_is(spark, monkeypatch):
    """No row for each character: the plan explodes nothing, and counts of any number of texts together equal those of the tokens."""
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab é字　𝄞\n\U0001f600ß") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(3, "again ab"), (60, None), (61, ""), (62, "x"), (63, " \t"), (64, "a\0b\0\0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    want = sorted(lexical.postings(docs, lexical.char_tokens).collect())
    found = lexical.char_postings(docs)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == want
    batch = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "").alias("bare")).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    for letters in (1, 50):
        monkeypatch.setattr(lexical, "LETTERS", letters)
        counted = Counter()
        for r in (r for b in lexical._char_counts(iter([batch])) for r in b.to_pylist()):
            counted[r["doc_id"], r["term"]] += r["tf"]
        assert sorted((d, t, n) for (d, t), n in counted.items()) == want


def test_spans_of_a_batch_are_plain_numbers():
    """Spans aren't held as objects: of texts with many, a batch costs some bytes a span."""
    texts = pa.array([None, "", "a\nb", *(["x\n" * 5000] * 40)])
    rule = lambda t: chunking.atoms(t, "line")
    tracemalloc.start()
    (found,) = chunking._listed(iter([texts]), rule)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.flatten()) == 200_002 and peak < 10e6
    assert found[:3].to_pylist() == [[], [], [{"start": 0, "end": 1}, {"start": 2, "end": 3}]]
    (none,) = chunking._listed(iter([pa.array(["", None])]), rule)
    assert none.to_pylist() == [[], []]


def test_normal_forms_leave_ascii_where_it_is(spark):
    """Only texts with other characters become Python's."""
    texts = ["abc", None, "ＡＢ１", "", "ﬁ é", "é", "字"]
    parts = [pa.array(texts), pa.array(texts).slice(2, 3), pa.array([], pa.string())]
    assert [a.to_pylist() for a in X._normal_forms(iter(parts))] == [[t and unicodedata.normalize("NFKC", t) for t in p.to_pylist()] for p in parts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.nfkc("t").alias("n"))
    assert [r["n"] for r in rows.orderBy("i").collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_pairs_looked_up_are_the_rows_made(spark):
    """Only pairs asked for leave the tasks: no join sorts them out of all questions by all documents."""
    base = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "idx long, vector array<double>").repartition(2)
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(50)], "query_id long, vector array<double>").toArrow()
    scorer = ranking.cosine(asked, 6)
    pairs = {(q, q * 3 + d) for q in range(50) for d in (0, 1)} | {(7, 1000), (999, 5)}
    found = ranking.looked_up(base, scorer, pa.table({"query_id": [q for q, _ in pairs], "idx": [d for _, d in pairs]}))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    rows = {(r["query_id"], r["idx"]): r["score"] for r in found.collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    assert rows == {(q, d): pytest.approx(float(unit([1, q]) @ unit([d % 7, 1])), abs=1e-6) for q, d in pairs if d < 200 and q < 50}


@pytest.mark.parametrize("negative", [False, True])
def test_words_by_number_score_as_words(spark, monkeypatch, negative):
    """Common words by products and rare ones by sums, over words or their numbers, in tiles of any size: all as one sum a pair."""
    rng = random.Random(7)
    names = [f"w{i}" for i in range(30)]
    docs = [(i, None if i == 5 else [w for j, w in enumerate(names + ["x", "y"]) for _ in range(rng.randint(1, 3)) if rng.random() < 4 / (j + 4)]) for i in range(150)]
    asked = pa.table({"query_id": pa.array([*range(40), 90]), "words": pa.array([[w for j, w in enumerate(names + ["z"]) if rng.random() < 3 / (j + 3)] * 2 for _ in range(40)] + [None], pa.list_(pa.string()))})
    cut = spark.createDataFrame(docs, "idx long, tokens array<string>").coalesce(2)
    known = ranking.vocabulary(asked)
    rows, terms, mean = ranking.indexed(cut, known)
    apart, mean_apart = ranking.statistics(cut)
    assert {r["term"]: (r["df"], pytest.approx(r["idf"])) for r in terms.collect()} == {r["term"]: (r["df"], r["idf"]) for r in apart.collect()} and mean == mean_apart
    if negative:
        terms = terms.withColumn("idf", F.when(F.col("term") == "w3", -F.col("idf")).when(F.col("term") == "w4", 0.0).otherwise(F.col("idf")))
    idf = {r["term"]: r["idf"] for r in terms.collect()}
    want = np.full((41, 150), np.nan)
    for q, words in enumerate(asked.column("words").to_pylist()):
        for d, said in docs:
            tf, many = Counter(said or ()), Counter(words or ())
            if any(w in tf for w in many):
                want[q, d] = sum(n * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(said) / mean)) for w, n in many.items() if w in tf)
    monkeypatch.setattr(ranking, "WORDS", 50)
    few = [b.column("tokens") for b in ranking._parts_of(iter(cut.toArrow().to_batches()))]
    assert all(len(c) == 1 or len(c.flatten()) <= 50 for c in few) and sum(map(len, few)) == 150
    for pairs, share, sums in ((1 << 17, 0.06, 1 << 20), (300, 0.5, 10), (7, 2.0, 1)):
        monkeypatch.setattr(ranking, "PAIRS", pairs)
        monkeypatch.setattr(ranking, "SHARE", share)
        monkeypatch.setattr(ranking, "SUMS", sums)
        for frame, given in ((cut, None), (rows, known)):
            scorer = ranking.bm25(asked, terms, mean, 6, given)
            for batch in frame.toArrow().to_batches():
                ids, scores = scorer(batch)
                np.testing.assert_allclose(scores, want[:, ids], atol=1e-6)


def test_equal_questions_are_asked_once(spark, monkeypatch):
    """Pairs of questions and chunks don't grow with copies of a question, and each copy still gets its own row."""
    texts = ["\n".join(f"line {i} {k} about topic{i * 100 + k} and more" for k in range(12)) for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(1, "line 1 3 about topic103 and more"), (2, "line 2 5 about topic205 and more"), (3, "line 1 3 about topic103 and more")]
    at = [(q, d, texts[d].index(t), len(t)) for (q, t), d in zip(asked, (1, 2, 1), strict=True)]
    spans = spark.createDataFrame([(q, d, a, a + n) for q, d, a, n in at], "query_id long, doc_id long, gs int, ge int")
    seen, rankings = [], grid.rankings
    monkeypatch.setattr(grid, "rankings", lambda chunks, questions, *a: seen.append(questions.count()) or rankings(chunks, questions, *a))
    got = grid.evaluate(docs, spark.createDataFrame(asked, "query_id long, text string"), spans, {"line": chunking.atom_spans("line")}, q.letter_counts)
    cells = {(r["ranker"], r["k"]): r for r in got.where("strategy = 'line'").collect()}
    assert seen == [2] and cells["bm25", 1]["queries"] == 3 and cells["bm25", 1]["hit"] == 1.0
