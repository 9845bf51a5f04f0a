"""Lines that many sites share, found by mergeable distinct-count sketches and removed but for their first place.

A line is what lies between ``\\n``, without ASCII white space at its ends; it counts if it has ``min_words`` words. Its
spread is the number of distinct sites it occurs on. Each task merges one HyperLogLog sketch per line before the shuffle.
Where a sketch's estimate is near the threshold, the sites of that line are counted exactly; so the verdict equals that of
exact counts. A line of ``min_sites`` sites or more is boilerplate: its first place, by document id, stays,
and every other place goes, so a passage is never lost from the corpus.

A null site is no site; a null text stays null; a text without such lines stays byte for byte. Rows are known by id and
text, so repeated rows are treated alike. Other columns pass through. Ties in the first place are broken by the
hash of id and text, then by line number. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.phrase_index import bounded
from corpusloom.llm.scratch import Scratch

MIN_SITES = 3
MIN_WORDS = 3
LOG_BUCKETS = 12
#: Estimates within so many standard errors of the threshold (and within one site) are counted exactly.
ERRORS = 4.0

_SPACE = " \t\n\x0b\x0c\r"


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.hash(text).alias("g"))


def _counted(min_words: int) -> str:
    word = r"[^\x20\x09-\x0D]"
    return rf"{word}+(?:[\x20\x09-\x0D]+{word}+){{{max(0, min_words - 1)}}}"


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``(row, id, site, pos, h, g)`` of the lines that count."""
    lines = docs.select(F.xxhash64("_id", "_text").alias("row"), F.col("_id").alias("id"), F.col("_site").alias("site"), F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(_SPACE))
    return lines.where(F.col("line").rlike(_counted(min_words))).select("row", "id", "site", "pos", _key(line).alias("k")).select("row", "id", "site", "pos", "k.h", "k.g")


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(h, g, n, first)`` of each line, by hash, on at least ``min_sites`` sites: its places and the first of them.

    ``docs`` has the columns _id, _text and _site.
    """
    scratch = Scratch(docs.sparkSession)
    lines = _lines(docs, min_words)
    spread = lines.groupBy("h", "g").agg(
        F.hll_sketch_agg("site", LOG_BUCKETS).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("id", "row", "pos")).alias("first")
    )
    # A line has no more sites than places.
    spread = spread.where(F.col("n") >= min_sites).select("h", "g", "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = scratch.save(spread, "spread")
    band = max(1.0, ERRORS * 1.04 / 2 ** (LOG_BUCKETS / 2) * min_sites)
    near = spread.where(F.abs(F.col("sites") - min_sites) <= band)
    sites = lines.join(bounded(near.select("h", "g")), ["h", "g"], "left_semi").where("site is not null").select("h", "g", "site").distinct()
    exact = sites.groupBy("h", "g").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    sure = spread.where(F.col("sites") - min_sites > band)
    return scratch.save(sure.select("h", "g", "n", "first").unionByName(near.join(exact, ["h", "g"]).select("h", "g", "n", "first")), "boilerplate")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated boilerplate lines cut from the text, plus ``_n_lines`` and ``_n_removed``, which replace columns of these names."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(site_col).cast("string").alias("_site"))
    found = boilerplate_lines(slim, min_sites, min_words)
    places = _lines(slim, min_words).join(bounded(found), ["h", "g"]).where("not (id <=> first.id and row = first.row and pos = first.pos)")
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    # Texts are told apart by id and hash.
    cut = places.groupBy(F.col("id").alias(f"{free}id"), F.col("row").alias(f"{free}row")).agg(F.collect_set("pos").alias(f"{free}cut"))
    own = F.col(id_col).eqNullSafe(F.col(f"{free}id")) & (F.xxhash64(F.col(id_col), F.col(text_col).cast("string")) == F.col(f"{free}row"))
    out = docs.join(cut, own, "left").drop(f"{free}id", f"{free}row")
    lines = F.coalesce(F.split(F.col(text_col).cast("string"), "\n"), F.array().cast("array<string>"))
    taken = F.coalesce(F.col(f"{free}cut"), F.array().cast("array<int>"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(taken, i))
    return out.withColumns({
        "_n_lines": F.size(lines).cast("long"),
        "_n_removed": F.size(taken).cast("long"),
        text_col: F.when(F.col(f"{free}cut").isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", kept)),
    }).drop(f"{free}cut")
