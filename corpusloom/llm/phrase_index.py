"""Benchmark passages in training texts, through a positional inverted index: DataFrame operations only.

Words are runs of ASCII letters and digits and of any character beyond ASCII, A-Z lower-cased. A window is ``width``
consecutive words of an item; an item of fewer words, but not none, is one window.

The index holds postings (term, row, position) for the terms that a search starts from. These are, of each window, the
two words with the fewest occurrences in the training texts, all of which are counted. A posting less its word's place in
the item is where the item would begin: lists so adjusted are intersected by grouping on that offset, and an offset stays if
both rare words of a window are there. Only these few are compared word by word.

Nulls and texts without words have no hits. Rows of repeated or null ids are told apart by a row number that the token
table stores. Columns other than id and text are ignored. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.scratch import Scratch

WIDTH = 10
#: Rare words that a window is looked up by.
ANCHORS = 2
#: Larger tables are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "".join(chr(c) for c in range(128) if not (chr(c).isalnum()))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and no words: an empty array."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() maps letters beyond A-Z too, so only pure ASCII takes that faster way.
    text = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    text = F.btrim(text, F.lit(_GAPS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _SPLIT))


def bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint, if all rows of ``df``, a stored table or little above one, take BROADCAST_BYTES at most."""
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema.fields)
    size = F.count("*") * 16 * len(df.columns) if fixed else F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= BROADCAST_BYTES else df


def token_table(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n_words, words)``, written once; each later pass reads it rather than split texts again."""
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    return scratch.save(words.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), "words"), "tokens")


def item_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(item_id, words, width)`` of the items with words."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return words.withColumn("width", F.least(F.lit(width), F.size("words")))


def occurrences(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: how often each of ``terms`` occurs in all texts."""
    return tokens.select(F.explode("words").alias("term")).join(bounded(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(tokens: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """The index: ``(term, row, pos)`` of every occurrence of ``terms``, stored."""
    return scratch.save(tokens.select("row", F.posexplode("words").alias("pos", "term")).join(bounded(terms), "term").select("term", "row", "pos"), "postings")


def _anchored(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Items with ``windows``: per window the places of its rarest words, rarest first, ties by place."""
    placed = items.select("item_id", F.posexplode("words").alias("pos", "term")).join(counts, "term", "left")
    ranked = placed.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("counts"))
    window = "array_sort(transform(slice(counts, i + 1, width), x -> struct(x.n as n, x.pos as pos)))"
    # A window with a word that no text has can't occur.
    windows = f"array_distinct(transform(filter(transform(sequence(0, size(words) - width), i -> {window}), w -> w[0].n > 0), w -> transform(slice(w, 1, {ANCHORS}), x -> x.pos)))"
    return items.join(ranked, "item_id").withColumn("windows", F.expr(windows)).where("size(windows) > 0").select("item_id", "words", "width", "windows")


def phrase_matches(tokens: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """``(row, item_id, start, width)``: every place where ``width`` words of a text equal a window of an item.

    ``starts`` of one alignment of text and item stay together in an array, no longer than the item.
    """
    items = scratch.save(items, "items")
    terms = scratch.save(items.select(F.explode("words").alias("term")).distinct(), "terms")
    items = scratch.save(_anchored(items, occurrences(tokens, terms)), "anchored")
    anchors = items.select("item_id", "words", F.explode(F.array_distinct(F.flatten("windows"))).alias("place"))
    anchors = scratch.save(anchors.select("item_id", "place", F.expr("words[place]").alias("term")), "anchors")
    index = postings(tokens, scratch.save(anchors.select("term").distinct(), "anchor-terms"), scratch)
    aligned = index.join(bounded(anchors), "term").groupBy("row", "item_id", (F.col("pos") - F.col("place")).alias("offset")).agg(F.collect_set("place").alias("places"))
    aligned = aligned.join(bounded(items), "item_id").where("exists(windows, w -> size(array_except(w, places)) = 0)").select("row", "item_id", "offset")
    aligned = scratch.save(aligned, "aligned")
    rows = scratch.save(aligned.select("row").distinct(), "aligned-rows")
    texts = tokens.select("row", F.col("words").alias("text_words")).join(bounded(rows), "row", "left_semi")
    both = aligned.join(texts, "row").join(bounded(items.select("item_id", "words", "width")), "item_id")
    equal = both.withColumn("equal", F.expr("transform(words, (w, i) -> coalesce(get(text_words, offset + i) = w, false))"))
    starts = "transform(filter(sequence(0, size(words) - width), i -> forall(slice(equal, i + 1, width), x -> x)), i -> i + offset)"
    return equal.select("row", "item_id", "width", F.expr(starts).alias("starts")).where("size(starts) > 0")


def proximity_matches(tokens: DataFrame, queries: DataFrame, within: int, scratch: Scratch) -> DataFrame:
    """``(row, query_id, pos)``: places of a query's rarest term with each other term at most ``within`` words away.

    ``queries(query_id, terms)`` has arrays of terms; the rarest, ties by spelling, leads.
    """
    wanted = scratch.save(queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")), "near-terms")
    terms = scratch.save(wanted.select("term").distinct(), "near-distinct")
    counts = occurrences(tokens, terms)
    lead = wanted.join(counts, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("lead"), F.count("*").alias("asked"))
    index = postings(tokens, terms, scratch)
    first = index.join(bounded(lead), F.col("term") == F.col("lead")).select("query_id", "row", "pos", "lead", "asked")
    near = wanted.join(index, "term").select(F.col("query_id").alias("q"), F.col("row").alias("r"), F.col("pos").alias("p"), "term")
    met = first.join(near, (F.col("query_id") == F.col("q")) & (F.col("row") == F.col("r")) & (F.abs(F.col("pos") - F.col("p")) <= within))
    return met.groupBy("row", "query_id", "pos", "asked").agg(F.count_distinct("term").alias("found")).where("found = asked").select("row", "query_id", "pos")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs(doc_id, text)``."""
    scratch = Scratch(docs.sparkSession)
    tokens = token_table(docs, scratch)
    found = scratch.save(phrase_matches(tokens, item_table(items, width=width), scratch), "matches")
    spans = "array_sort(flatten(collect_list(transform(starts, s -> struct(s as start, s + width as stop)))))"
    # Spans in order: each adds what lies beyond the furthest end so far.
    covered = "aggregate(spans, struct(0L as hit, 0 as far), (a, s) -> struct(a.hit + greatest(0, s.stop - greatest(s.start, a.far)) as hit, greatest(a.far, s.stop) as far), a -> a.hit)"
    per_row = found.groupBy("row").agg(F.expr(spans).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_row = per_row.select("row", F.expr(covered).alias("n_hit"), "items")
    out = tokens.select("row", F.col("id").alias("doc_id"), "n_words").join(per_row, "row", "left")
    none = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(none).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", none), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` whose text has no window of an item. Rows with null or repeated ids are told apart by their texts."""
    found = contamination(docs.select(F.struct("doc_id", _text_key("text").alias("key")).alias("doc_id"), "text"), items, width)
    dirty = found.where("contaminated").select(F.col("doc_id.doc_id").alias("_dirty_id"), F.col("doc_id.key").alias("_dirty_key")).distinct()
    dirty = Scratch(docs.sparkSession).save(dirty, "dirty")
    return docs.join(bounded(dirty), docs["doc_id"].eqNullSafe(F.col("_dirty_id")) & (_text_key(docs["text"]) == F.col("_dirty_key")), "left_anti")


def _text_key(text: Column | str) -> Column:
    text = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    return F.concat_ws(" ", F.xxhash64(text), F.octet_length(text))
