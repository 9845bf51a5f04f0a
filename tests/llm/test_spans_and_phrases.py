"""Collocations, fill-in-the-middle examples and suffix dedup against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import collocations, fill_middle, queries, suffix_dedup
from corpusloom.llm.wavelet import WaveletMatrix
from tests.conftest import DATA
from tests.llm.test_operators import LONG, awkward, docs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def result(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_fill_in_middle"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want, got = con.execute(queries.ORACLES[name]), queries.QUERIES[name](spark, DATA)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert result(got.collect(), got.columns) == result(want.fetchall(), names)


def test_wavelet():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 7, size).astype(np.uint8)
        made, at = WaveletMatrix(symbols, 3), np.arange(size + 1)
        for s in range(8):
            assert made.rank(s, at).tolist() == np.append(0, np.cumsum(symbols == s)).tolist()
        if size:
            left = rng.integers(0, size, 40)
            right = left + rng.integers(1, size + 1, 40).clip(max=size - left)
            which, symbol, a, b = made.split(left, right)
            start = made.starts()
            got = {(w, s): (x - start[s], y - start[s]) for w, s, x, y in zip(which, symbol, a, b, strict=True)}
            want = {(i, s): ((symbols[:x] == s).sum(), (symbols[:y] == s).sum()) for i, (x, y) in enumerate(zip(left, right, strict=True)) for s in set(symbols[x:y].tolist())}
            assert got == want


# 11


def phrases(rows, longest, least, top, cover):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(100 * b >= cover * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def some_prose(n, seed=5):
    rng, out = random.Random(seed), []
    words = ["a", "b", "C", "d", "é", "É", "aa", "x-y", "(q)"]
    for _ in range(n):
        out.append((rng.choice(["en", "fr", None]), "".join(rng.choices(words, [9, 7, 5, 3, 2, 1, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ; "]) for _ in range(rng.randint(0, 60)))))
    return out + [("en", None), ("en", ""), (None, " \n.,"), ("en", "a\x00b c d a\x00b")]


@pytest.mark.parametrize(("longest", "numbered"), [(3, None), (3, 4), (3, 0), (2, None), (4, 3)])
def test_collocations(spark, longest, numbered):
    """Whatever number of words gets numbers, and for shorter and longer windows."""
    rows = some_prose(60)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n long, w0 string").repartition(3)
    got = collocations.collocations(df, longest, 5, 40, numbered=numbered)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, longest, 5, 40, 50)


def test_collocations_of_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    rows = [([1], 4_000_000_000_001), ([2], 3_000_000_000_007), ([1, 2], 2_999_999_999_999)]
    got = collocations.scored(spark.createDataFrame(rows, "p array<long>, n long")).first()
    assert got["score"] == 10**6 * 2_999_999_999_999**2 // (4_000_000_000_001 * 3_000_000_000_007)


def test_collocations_of_awkward_rows(spark):
    found = {(r["lang"], r["phrase"]) for r in collocations.collocations(awkward(spark), least=2).collect()}
    assert ("en", "a b c") in found or ("und", "w1 w2 w3") in found
    assert collocations.collocations(awkward(spark, [])).count() == 0


# 12


def test_examples_of_awkward_rows(spark):
    df = awkward(spark).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(["a <P> b", "x <S", "S> y", " lead é 😀 tail \n"] * 12)], "doc_id long, text string"), allowMissingColumns=True).withColumnRenamed("token", "fim_text")
    out = fill_middle.fill_in_middle(df)
    assert out.columns == [c for c in df.columns if c not in ("text", "fim_text")] + ["fim_text", "fim_form", "fim_tokens", "fim_prefix_chars", "fim_middle_chars"]
    back = out.withColumn("back", fill_middle.restored(out["fim_text"], out["fim_form"])).collect()
    assert Counter((r["doc_id"], r["back"]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    assert {r["fim_form"] for r in back} == {"plain", "psm", "spm"}
    for r in back:
        words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", r["back"])
        h = [int(hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted(x % (len(words) + 1) for x in h[:2])
        assert r["fim_tokens"] == len(words)
        if r["fim_form"] == "plain":
            assert r["fim_prefix_chars"] is None and r["fim_text"] == r["back"]
        else:
            p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
            assert (r["fim_prefix_chars"], r["fim_middle_chars"]) == (len(p), len(m))
            assert r["fim_text"] == (f"<P>{p}<S>{s}<M>{m}" if r["fim_form"] == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert fill_middle.fill_in_middle(awkward(spark, [])).count() == 0


# 13


def left(texts, length):
    """Plain: count every string of that length, then cover."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cut = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = [True] * length
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        out.append((len(b), sum(cut), sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut)), kept))
    return out


def removed(df, length=200):
    return [tuple(bytes(r[c]) if c == "kept_bytes" else r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_bytes")) for r in suffix_dedup.cut_repeats(df, length=length).collect()]


def test_repeats_in_documents(spark):
    rows = docs(spark).select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_suffix_array_dedup(spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {r["doc_id"]: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for r, x in zip(rows, left([r["text"] for r in rows], 200), strict=True)}


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_repeats_of_short_strings(spark, monkeypatch, most):
    """Few letters, periodic texts, shared passages with and without edits; groups small and dealt out again by longer grams."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", most)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(70))
    texts = ["a" * 90, "a" * 21, "ab" * 40, "", None, "é" * 15, "\0" * 30 + passage, "".join(rng.choice("ab") for _ in range(400))]
    for _ in range(60):
        t = list(passage)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(70)] = rng.choice("xyz")
        texts.append("".join(rng.choice("klmn") for _ in range(rng.randint(0, 30))) + "".join(t) + "".join(rng.choice("klmn") for _ in range(rng.randint(0, 30))))
    texts += texts[10:13]
    df = spark.createDataFrame([(i if i % 7 else None, t, 1, "x", b"z") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes long, d string, kept_bytes binary").repartition(4)
    assert Counter(removed(df, 20)) == Counter(left(texts, 20))


def test_repeats_of_awkward_rows(spark):
    texts = [r["text"] for r in awkward(spark).collect()]
    got = Counter(x[:3] for x in removed(awkward(spark)))
    assert got[(len(LONG), len(LONG), 1)] == 1 and sum(got.values()) == len(texts)
    assert removed(awkward(spark, [])) == []
    out = suffix_dedup.cut_repeats(awkward(spark))
    assert out.columns == [c for c in awkward(spark).columns if c != "text"] + ["kept_bytes", "n_bytes", "n_removed", "n_spans"]
