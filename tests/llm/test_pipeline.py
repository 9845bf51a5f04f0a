"""The pipeline's stages against brute force, each on what its predecessor kept."""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

import corpus_pipeline
from corpusloom.llm import queries, scratch
from tests.conftest import DATA
from tests.llm.test_operators import awkward, contaminated, linked, rank_reference, table  # noqa: F401

SPACE = " \t\n\x0b\x0c\r"


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def lines_cut(docs):
    """Texts without later places of lines on three sources."""
    sites, first = defaultdict(set), {}
    for i in sorted(docs):
        for p, line in enumerate((docs[i]["text"] or "").split("\n")):
            k = line.strip(SPACE)
            if len(k.split()) >= 3:
                sites[k].add(docs[i]["source"])
                first.setdefault(k, (i, p))
    out = {}
    for i, d in docs.items():
        lines = (d["text"] or "").split("\n")
        kept = [x for p, x in enumerate(lines) if len(sites[x.strip(SPACE)]) < 3 or first[x.strip(SPACE)] == (i, p)]
        if len(kept) == len(lines) or "".join(kept).strip(SPACE):
            out[i] = "\n".join(kept)
    return out


def test_stages(spark, rank_reference):  # noqa: F811
    tables, docs = scratch.Scratch(spark), spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]
    kept = [rows(docs)]
    for name, stage in corpus_pipeline.STAGES:
        out = tables.save(stage(spark, docs, DATA), name)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = out
        kept.append(rows(docs))
    start, known, cut, single, clean, tokens = kept
    assert known == {i: d for i, d in start.items() if i in known} and len(known) > 0.97 * len(start)
    assert {i: d["text"] for i, d in cut.items()} == lines_cut(known) and all(d["n_chars"] == len(d["text"]) for d in cut.values())
    groups = linked({i: d["text"] for i, d in cut.items()})
    assert single == {i: d for i, d in cut.items() if groups[i][1] == i} and len(single) < len(cut)
    bench = table("benchmark")
    items = list(zip(bench.item_id, bench.text, strict=True))
    assert clean == {i: d for i, d in single.items() if not contaminated(d["text"], items)[-1]} and len(clean) < len(single)
    assert tokens.keys() == clean.keys()
    for i, r in tokens.items():
        ids = rank_reference.encode_ordinary(clean[i]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(clean[i]["text"].encode()).hexdigest()


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert queries.QUERIES.keys() >= {"op1_line_dedup", "op10_language_id"}


def test_stages_take_awkward_rows(spark):
    for rows_ in (None, []):
        df = awkward(spark, rows_)
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, df, DATA)
            assert out.columns == df.columns, name
            assert out.count() <= df.count()
