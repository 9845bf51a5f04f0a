"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, chat, collocations, fill_middle, language_id, line_dedup, ngram_join, phrase_index, pitman_yor, quality_rules, rule_ensemble, suffix_dedup, unigram_count

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary files, from the folder of public tokenizers.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> Column:
    """The remainder that deals documents out to folds; a null id is dealt as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, boilerplate lines removed, and the text that is left."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, source, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM docs),
keyed AS (SELECT doc_id, source, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+')),
common AS (SELECT k, min(struct_pack(d := doc_id, p := pos)) AS f FROM keyed GROUP BY k HAVING count(DISTINCT source) >= 3),
cut AS (SELECT doc_id, list(pos) AS cut FROM keyed JOIN common USING (k) WHERE NOT (doc_id = f.d AND pos = f.p) GROUP BY doc_id),
kept AS (SELECT doc_id, len(ls) AS n, coalesce(len(cut), 0) AS r,
         CASE WHEN cut IS NULL THEN text ELSE array_to_string([ls[i + 1] FOR i IN range(len(ls)) IF NOT list_contains(cut, i)], chr(10)) END AS t
         FROM docs LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(r AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS kept_chars, sha256(t) AS kept_sha256 FROM kept
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed rules, then robust outliers per language and source."""
    return quality_rules.judge(_table(spark, sf_dir).select("doc_id", "lang", "source", "text")).drop("distance")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of benchmark items."""
    return phrase_index.contamination(_table(spark, sf_dir).select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, coalesce([x FOR x IN string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''], []) AS w FROM low),
ilow AS (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
items AS (SELECT item_id, coalesce([x FOR x IN string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''], []) AS w FROM ilow),
short AS (SELECT DISTINCT least(len(w), 10) AS n FROM items WHERE len(w) > 0),
iwin AS (SELECT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') FOR i IN range(len(w) - least(len(w), 10) + 1)]) AS g FROM items WHERE len(w) > 0),
starts AS (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS s FROM docs, short WHERE len(w) >= n),
hits AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g FROM starts) JOIN iwin USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as digests."""
    return byte_bpe.round_trip(_table(spark, sf_dir).select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)


def op5_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, read back from the formatted examples."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.prefix_targets(turns.unionByName(own)))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component of near duplicates."""
    return ngram_join.near_duplicate_components(_table(spark, sf_dir).select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document under a unigram vocabulary."""
    return unigram_count.with_counts(_table(spark, sf_dir).select("doc_id", "text"), PIECES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document, learned from those of four folds in five."""
    docs = _table(spark, sf_dir).select("doc_id", (fold(5) == 1).alias("held_out"), "text")
    model = pitman_yor.Model(docs.where("not held_out"))
    scored = model.score(docs)
    model.close()
    return scored


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, learned from the labels of four folds in five."""
    docs = _table(spark, sf_dir).select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold(5) != 0)
    out = rule_ensemble.score(docs, rule_ensemble.train(docs, labels))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages, learned from two folds in three."""
    docs = _table(spark, sf_dir)
    model = language_id.train(docs.where(fold(3) != 1).select("text", "lang"))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of two or three words."""
    return collocations.collocations(_table(spark, sf_dir).select("lang", "text"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
cut AS MATERIALIZED (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
led AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut)),
one AS MATERIALIZED (SELECT lang, x, count(*) AS n FROM led GROUP BY ALL),
two AS MATERIALIZED (SELECT lang, x, y, count(*) AS n FROM led WHERE y IS NOT NULL GROUP BY ALL),
three AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS n FROM led WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(n) AS n FROM one GROUP BY lang),
cuts AS (SELECT t.lang, t.x, t.y, NULL AS z, t.n AS a, 1 AS k, u.n AS l, v.n AS r FROM two t JOIN one u ON u.lang = t.lang AND u.x = t.x JOIN one v ON v.lang = t.lang AND v.x = t.y WHERE t.n >= 10
         UNION ALL SELECT t.lang, t.x, t.y, t.z, t.n, 1, u.n, v.n FROM three t JOIN one u ON u.lang = t.lang AND u.x = t.x JOIN two v ON v.lang = t.lang AND v.x = t.y AND v.y = t.z
         UNION ALL SELECT t.lang, t.x, t.y, t.z, t.n, 2, u.n, v.n FROM three t JOIN two u ON u.lang = t.lang AND u.x = t.x AND u.y = t.y JOIN one v ON v.lang = t.lang AND v.x = t.z),
held AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, x, y, z ORDER BY score, k) AS i FROM held) WHERE i = 1),
inside AS (SELECT lang, x, y, max(n) AS most FROM (SELECT lang, x, y, n FROM three UNION ALL SELECT lang, y, z, n FROM three) GROUP BY ALL),
kept AS (SELECT b.lang, concat_ws(' ', b.x, b.y, b.z) AS phrase, a, l, r, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.x = b.x AND i.y = b.y WHERE b.z IS NOT NULL OR most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a fill-in-the-middle example, and what the example restores to, as digests."""
    out = fill_middle.fill_in_middle(_table(spark, sf_dir).select("doc_id", "text"))
    back = fill_middle.restored(F.col("fim_text"), F.col("fim_form"))
    return out.select(
        "doc_id", F.col("fim_tokens").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, [CAST('0x' || substring(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM docs),
cut AS (SELECT doc_id, t, w, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, t, n, form, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 :], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes, those of passages of 200 bytes that start elsewhere too, and a digest of the others."""
    out = suffix_dedup.cut_repeats(_table(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_line_dedup, op2_quality_rules, op3_decontamination, op4_byte_bpe, op5_chat_prefix_targets,
        op6_ngram_jaccard_join, op7_token_counts, op8_lm_scoring, op9_quality_classifier, op10_language_id,
        op11_collocations, op12_fill_in_middle, op13_suffix_array_dedup,
    )
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op11_collocations": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
