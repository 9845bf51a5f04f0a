"""Rules over the lines of each document, as windows: all share one exchange by document.

Lines are rows ``(doc_id, pos, line)``; pos orders them and need not be dense. Every rule keeps documents apart, takes
nulls as empty lines and leaves no line behind for an empty document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from corpusloom.functions import text as X
from corpusloom.operators import streams
from corpusloom.storage import stored


# Layout lines of the source documents and notes put in for a demonstration.
LAYOUT_NOISE = (
    r"(?U)^XX商城售后服务中心\s*[|｜]\s*客户服务部内部资料\s*$",
    r"(?U)^www\.example-shop\.com\s*[|｜]\s*资料编号\s*[：:]\s*AF-2026-08\s+第\s*\d+\s*页\s*/\s*共\s*\d+\s*页\s*$",
    r"(?U)^XX商城售后服务中心\s*$",
    r"(?U)^客户服务部内部资料(?:\s*客户服务部内部资料)+\s*$",
    r"(?U)^#{4,}\s*$",
    r"(?U)^-{2,}\s*分隔线\s*-{2,}\s*$",
)
DEMO_NOTE = r"(?U)^【(?:异常数据\s*\d+|清洗注意)】"
_NUMBER = r"\d+[、.．)）]"


def by_doc() -> WindowSpec:
    """A document's lines in order."""
    return W.partitionBy("doc_id").orderBy("pos")


def so_far() -> WindowSpec:
    """A document's lines up to the current one."""
    return by_doc().rowsBetween(W.unboundedPreceding, 0)


def to_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Split texts at any line break; a break at the end opens no line. An empty text has no lines."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\R\z", "")
    rows = docs.where(F.coalesce(F.col(text), F.lit("")) != "").select("doc_id", F.posexplode(F.split(body, r"\R|[\x1c-\x1e]")).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def to_text(lines: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with lines joined in order."""
    gathered = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return gathered.select("doc_id", F.array_join(F.col("l.line"), "\n").alias("text"))


def drop_noise(lines: DataFrame, patterns: Sequence[str] = LAYOUT_NOISE, notes: str | None = DEMO_NOTE) -> tuple[DataFrame, DataFrame]:
    """Lines without control marks, blanks at the ends, and layout noise; and the audit of what was dropped."""
    bare = lines.withColumn("line", X.strip(F.translate(F.coalesce("line", F.lit("")), "\0﻿", "")))
    rule = F.when(F.col("line").rlike(notes), "note") if notes else F.when(F.lit(False), "note")
    for p in patterns:
        rule = rule.when(F.col("line").rlike(p), "layout_noise")
    marked = bare.withColumn("rule", rule)
    return marked.where("rule is null").drop("rule"), marked.where("rule is not null").select("doc_id", "rule", "pos", F.col("line").alias("before"))


def normalize_lists(lines: DataFrame) -> DataFrame:
    """All list marks become ``- ``; a line of several numbered items becomes one line each (pos, then sub orders them)."""
    s = X.strip(F.col("line"))
    mark = r"(?U)^(?:\(cid:\d+\)\s*|l\s+|[-*•]\s+)"
    cut = F.filter(F.transform(F.split(s, f"(?={_NUMBER})"), X.strip), lambda p: p.rlike(f"^{_NUMBER}"))
    items = F.transform(cut, lambda p: F.rtrim(X.strip(F.regexp_replace(p, f"(?U)^{_NUMBER}\\s*", "")), F.lit("。；;，,")))
    found = F.when(s.rlike(mark), F.array(X.strip(F.regexp_replace(s, mark, "")))).when(s.rlike(f"^{_NUMBER}"), items)
    whole = lines.withColumn("items", found)
    parts = whole.select("doc_id", "pos", "line", F.posexplode_outer("items").alias("sub", "item"))
    parts = parts.withColumn("sub", F.coalesce("sub", F.lit(0)))
    # A bare line that repeats an earlier item is an item itself.
    key = F.coalesce("item", X.strip(F.col("line")))
    first = F.min(F.when(F.col("item").isNotNull(), F.struct("pos", "sub"))).over(W.partitionBy("doc_id", "key"))
    seen = parts.withColumn("key", key).withColumn("first", first)
    is_item = F.col("item").isNotNull() | ((F.col("key") != "") & (F.col("first") < F.struct("pos", "sub")))
    return seen.select("doc_id", "pos", F.col("sub").cast("long").alias("sub"), F.when(is_item, F.concat(F.lit("- "), F.col("key"))).otherwise(F.col("line")).alias("line"))


def join_broken(lines: DataFrame, marks: str = X.TERMINAL_MARKS, heading: str = X.HEADING) -> DataFrame:
    """Lines that break within a sentence become one; ``joined`` counts the breaks closed. The first line with text, if plain, stays alone.

    A line starts a new one if it or its predecessor is special, or if the predecessor ends a sentence or is the title.
    """
    flags = lines.select("doc_id", "pos", "line", X.is_special(F.col("line"), heading).alias("special"), X.ends_terminal(F.col("line"), marks).alias("done"), X.is_blank(F.col("line")).alias("blank"))
    flags = flags.withColumn("title", ~F.col("special") & (F.sum((~F.col("blank")).cast("int")).over(so_far()) == 1))
    starts = F.col("special") | F.lag("special", 1, True).over(by_doc()) | F.lag("done", 1, True).over(by_doc()) | F.lag("title", 1, True).over(by_doc())
    glue = F.lag("line").over(by_doc()).rlike(f"[{X.CJK}]$") & F.col("line").rlike("^[0-9A-Za-z]")
    marked = flags.select("doc_id", "pos", "line", starts.alias("starts"), F.when(~starts & glue, " ").otherwise("").alias("glue"))
    grouped = marked.withColumn("run", F.sum(F.col("starts").cast("int")).over(so_far())).groupBy("doc_id", "run")
    out = grouped.agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", F.concat("glue", "line").alias("line")))).alias("l"))
    return out.select("doc_id", "pos", F.array_join(F.col("l.line"), "").alias("line"), (F.size("l") - 1).cast("long").alias("joined"))


def dedup_within(lines: DataFrame) -> DataFrame:
    """The first line of each content in a document; a list mark makes no difference. Blank lines stay."""
    key = F.regexp_replace(X.strip(F.col("line")), r"(?U)^[-*•]\s+", "")
    ranked = lines.withColumn("key", key).withColumn("turn", F.row_number().over(W.partitionBy("doc_id", "key").orderBy("pos")))
    return ranked.where((F.col("turn") == 1) | X.is_blank(F.col("line"))).drop("key", "turn")


def compact_blanks(lines: DataFrame) -> DataFrame:
    """One blank line in a row at most, none at a document's ends."""
    blank = lines.withColumn("blank", X.is_blank(F.col("line")))
    ends = W.partitionBy("doc_id")
    full = F.when(~F.col("blank"), F.col("pos"))
    edged = blank.withColumns({"before": F.lag("blank", 1, True).over(by_doc()), "last": F.max(full).over(ends)})
    kept = edged.where(~F.col("blank") | (~F.col("before") & (F.col("pos") < F.col("last"))))
    return kept.select("doc_id", "pos", F.when(F.col("blank"), "").otherwise(F.col("line")).alias("line"))


def dedup_sentences(lines: DataFrame, marks: str = "。！？；", least: int = 8, heading: str = X.HEADING, deals: int | None = None) -> DataFrame:
    """Plain lines without the sentences said before in the document; those shorter than ``least`` always stay. ``dropped`` counts.

    A line all of whose sentences go is gone. ``deals``: partitions to deal documents out to.
    """
    plain = ~X.is_special(F.col("line"), heading)
    parts = F.when(plain, X.split_sentences(F.col("line"), marks)).otherwise(F.array("line"))
    # Cut before the exchange that the window asks for anyway: else Spark works out the sentences again for each use of a piece.
    cut = lines.select("doc_id", "pos", plain.alias("plain"), parts.alias("parts")).repartition(*([deals] if deals else []), "doc_id")
    units = cut.select("doc_id", "pos", "plain", F.posexplode("parts").alias("seg", "unit"))
    counted = F.col("plain") & (F.char_length("unit") >= least)
    turn = F.row_number().over(W.partitionBy("doc_id", "counted", "unit").orderBy("pos", "seg"))
    ranked = units.withColumn("counted", counted).withColumn("keep", ~F.col("counted") | (turn == 1))
    grouped = ranked.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("seg", "unit")))).alias("l"), F.count_if(~F.col("keep")).alias("dropped"))
    return grouped.where(F.size("l") > 0).select("doc_id", "pos", F.array_join(F.col("l.unit"), "").alias("line"), "dropped")


def units(lines: DataFrame, marks: str = "。！？；", heading: str = X.HEADING, dealt: bool = True) -> DataFrame:
    """Sentences of plain lines and contents of list items: ``(doc_id, pos, seg, unit)``; ``dealt`` out by document, for what groups by it."""
    item = X.is_list_item(F.col("line"))
    kept = lines.where(item | ~X.is_special(F.col("line"), heading))
    content = F.array(X.strip(F.regexp_replace(X.strip(F.col("line")), "^- ", "")))
    cut = kept.select("doc_id", "pos", F.when(item, content).otherwise(X.split_sentences(F.col("line"), marks)).alias("parts"))
    return (cut.repartition("doc_id") if dealt else cut).select("doc_id", "pos", F.posexplode("parts").alias("seg", "unit"))


def dedup_units(rows: DataFrame, least: int = 6) -> DataFrame:
    """The first unit of each normal form in a document; normal forms shorter than ``least`` always stay."""
    normed = rows.withColumn("norm", X.normalize_unit(F.col("unit")))
    turn = F.row_number().over(W.partitionBy("doc_id", "norm").orderBy("pos", "seg"))
    return normed.withColumn("turn", turn).where((F.col("turn") == 1) | (F.char_length("norm") < least)).drop("turn")


#: Units that meet as one side of a product.
UNITS = 2048


def gram_cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct character pairs of each text, as (text, pair) numbers in order of the texts, and how many each has; of one character, that character."""
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), length)
    # Code points have 21 bits; a character by itself is followed by none.
    follows = np.append((row[1:] == row[:-1]), False)[: len(row)]
    pair = (points << 21 | np.append(points[1:], 0)[: len(row)]) + 1
    alone = (length == 1)[row]
    letters, gram = np.unique(np.where(follows, pair, -points - 1)[follows | alone], return_inverse=True)
    cells = np.unique(row[follows | alone] * max(len(letters), 1) + gram)
    unit, gram = np.divmod(cells, max(len(letters), 1))
    return unit, gram, np.bincount(unit, minlength=len(texts))


def similar_units(rows: DataFrame, threshold: float = 0.8, least: int = 6) -> DataFrame:
    """Pairs of a document's units, by normal form, whose bigram sets have at least this Jaccard similarity: ``(doc_id, a, b, sim)``.

    a and b are normal forms, a before b by spelling.
    """
    found = unit_pairs(rows, threshold, threshold, 0, least)
    return found.select("doc_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def unit_pairs(rows: DataFrame, fuzzy: float = 0.8, weak: float = 0.4, keep: int = 3, least: int = 6, block: int = UNITS) -> DataFrame:
    """What looks alike among a document's units: ``(doc_id, kind, a, b, sim)``, a before b in the document.

    All pairs at ``fuzzy`` or more, and of those at ``weak`` or more the ``keep`` nearest, first in the document of equal ones; sim has three
    digits. Bigrams are so few that nearly all units share some, so an index of bigrams would find nearly all pairs. Instead blocks of
    a document's units meet, and products of 0/1 rows count the shared bigrams of whole blocks. A task holds two blocks; a unit of a
    document of n blocks is sent n times. Only the pairs asked for leave a task, of weak ones ``keep`` a product.
    """

    def pairs(doc: int, i: int, j: int, place: np.ndarray, at: np.ndarray, cell: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> list[tuple]:
        first, second = np.flatnonzero(at == i), np.flatnonzero(at == j)
        grams, column = np.unique(cell[1], return_inverse=True)
        has = np.zeros((len(place), len(grams)), np.float32)
        has[cell[0], column] = 1
        near: list[tuple[float, int, int]] = []
        out = []
        for start in range(0, len(first), 512):
            mine = first[start : start + 512]
            both = (has[mine] @ has[second].T).astype(np.float64)
            sim = both / (size[mine, None] + size[None, second] - both)
            sim[place[mine][:, None] >= place[second][None]] = -1
            out += [("fuzzy", int(mine[i]), int(second[j]), sim[i, j]) for i, j in np.argwhere(sim >= fuzzy)]
            if keep:
                rounded = np.where((sim >= weak) & (sim < fuzzy), np.round(sim, 3), -1)
                found = np.flatnonzero(rounded.ravel() >= max(weak - 0.001, np.partition(rounded.ravel(), -min(keep, rounded.size))[-min(keep, rounded.size)]))
                i, j = np.divmod(found, rounded.shape[1])
                best = np.lexsort((second[j], mine[i], -rounded[i, j]))[:keep]
                near = sorted(near + [(-rounded[i[x], j[x]], int(mine[i[x]]), int(second[j[x]])) for x in best])[:keep]
        out += [("weak", i, j, -s) for s, i, j in near]
        return [(doc, kind, i, j, float(np.round(s, 3)), int(place[i]), int(place[j])) for kind, i, j, s in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in streams.whole_groups(batches, 3):
            doc, i, j, place, at = (table.column(k).to_numpy() for k in range(5))
            norm = table.column(5).combine_chunks()
            unit, gram, size = gram_cells(norm)
            out, ends = [], np.searchsorted(unit, [*starts, len(doc)])
            for (a, b), (x, y) in zip(pairwise([*starts, len(doc)]), pairwise(ends.tolist()), strict=True):
                found = pairs(int(doc[a]), int(i[a]), int(j[a]), place[a:b], at[a:b], (unit[x:y] - a, gram[x:y]), size[a:b])
                out += [(d, kind, a + p, a + q, *rest) for d, kind, p, q, *rest in found]
            columns = list(zip(*out, strict=True)) or [()] * 7
            left, right = (norm.take(pa.array(c, pa.int64())) for c in columns[2:4])
            kinds = [pa.array(c, t) for c, t in zip((*columns[:2], *columns[4:]), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*kinds[:2], left, right, *kinds[2:]], ["doc_id", "kind", "a", "b", "sim", "at", "to"])

    distinct = rows.where(F.char_length("norm") >= least).groupBy("doc_id", "norm").agg(F.min(F.struct("pos", "seg")).alias("first"))
    order, doc = W.partitionBy("doc_id").orderBy("first"), W.partitionBy("doc_id")
    placed = distinct.select("doc_id", "norm", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(doc).alias("n"))
    placed = placed.withColumn("block", F.floor(F.col("place") / block))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    # The windows have brought each document into one task; there its products follow each other.
    met = dealt.select("doc_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("place").cast("long").alias("place"), "block", "norm")
    found = met.sortWithinPartitions("doc_id", "i", "j", "place").mapInArrow(run, "doc_id long, kind string, a string, b string, sim double, at long, to long")
    if not keep:
        return found.select("doc_id", "kind", "a", "b", "sim")
    turn = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy(F.col("sim").desc(), "at", "to"))
    return found.withColumn("turn", turn).where((F.col("kind") == "fuzzy") | (F.col("turn") <= keep)).select("doc_id", "kind", "a", "b", "sim")


def clean_tables(lines: DataFrame) -> DataFrame:
    """Tables without empty columns, repeated rows and repeated headers: ``(doc_id, pos, sub, line)``.

    A table is a run of lines that start with a bar. It is cleaned if a separator row follows its header. Rows whose first
    cell an earlier kept row of the document has are repeats; so are equal rows of one table. A table without rows is
    dropped; a header equal to that of the table kept before is not written again. Steps that several others read are stored.
    """
    flagged = lines.withColumn("is_row", X.is_table_row(F.col("line")))
    new = F.col("is_row") & ~F.lag("is_row", 1, False).over(by_doc())
    flagged = flagged.withColumn("block", F.sum(new.cast("int")).over(so_far()))
    pieces = F.split("line", r"\|")
    cells = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), X.strip)
    rows = flagged.where("is_row").withColumn("cells", cells)
    in_block = W.partitionBy("doc_id", "block").orderBy("pos")
    whole = W.partitionBy("doc_id", "block")
    sep = F.forall("cells", lambda c: (c == "") | c.rlike("^:?-{3,}:?$"))
    rows = stored(rows.withColumn("nth", F.row_number().over(in_block)).withColumn("sep", F.min(F.when(sep & (F.col("nth") > 1), F.col("nth"))).over(whole)))
    raw = rows.where("sep is null").select("doc_id", "pos", F.lit(0).cast("long").alias("sub"), "line")
    table = rows.where("sep is not null and (nth = 1 or nth > sep)").withColumn("width", F.max(F.size("cells")).over(whole))
    table = table.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit(""))))
    # Columns with any text stay, by the same choice for all rows of the table.
    filled = table.select("doc_id", "block", F.posexplode("cells").alias("col", "cell")).where(F.col("cell") != "").groupBy("doc_id", "block").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    table = table.join(filled, ["doc_id", "block"]).withColumn("cells", F.transform("cols", lambda i: X.normalize_cell(F.get("cells", i))))
    header = F.first("cells").over(in_block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    data = table.withColumn("header", header).where("nth > 1").withColumn("key", F.get("cells", F.lit(0)))
    first = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("pos")) == 1
    blank = F.row_number().over(W.partitionBy("doc_id", "block", "cells").orderBy("pos")) == 1
    data = stored(data.withColumns({"first": first, "fresh": blank}).where(F.when(F.col("key") == "", F.col("fresh")).otherwise(F.col("first"))))
    heads = data.groupBy("doc_id", "block").agg(F.first("header").alias("header"), F.min("pos").alias("pos"))
    heads = heads.withColumn("before", F.lag("header").over(W.partitionBy("doc_id").orderBy("block"))).where("not (header <=> before)")

    def row(c: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))

    rule = F.transform("header", lambda _: F.lit("---"))
    written = heads.select("doc_id", "pos", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("sub"), row(F.col("header")).alias("line")), F.struct(F.lit(-1).cast("long").alias("sub"), row(rule).alias("line")))).alias("r")).select("doc_id", "pos", "r.*")
    body = data.select("doc_id", "pos", F.lit(0).cast("long").alias("sub"), row(F.col("cells")).alias("line"))
    other = lines.where(~X.is_table_row(F.col("line"))).select("doc_id", "pos", F.lit(0).cast("long").alias("sub"), "line")
    return other.unionByName(raw).unionByName(written).unionByName(body)


def renumber(lines: DataFrame) -> DataFrame:
    """Dense positions again, after rules that split lines."""
    return lines.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "sub")) - 1).cast("long").alias("pos"), "line")


#: Bytes of lines in a partition of ``clean``, with so many for each line besides its text.
DEAL, LINE = 8_000_000, 40


def clean(docs: DataFrame) -> DataFrame:
    """All rules in their order over ``docs(doc_id, text)``: ``(doc_id, text)``.

    A task's memory is the sum over the sorts and sums of its stage. So the rules run in stages of a few sorts each, cut by stored tables, and
    documents are dealt out to as many partitions as their bytes ask for: only a document longer than that makes a larger one.
    """
    lines = stored(drop_noise(to_lines(docs))[0])
    size = lines.agg(F.sum(F.octet_length("line") + LINE)).first()[0] or 0
    deals = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // DEAL))

    def dealt(rows: DataFrame) -> DataFrame:
        return stored(rows).repartition(deals, "doc_id")

    lines = dealt(renumber(normalize_lists(lines.repartition(deals, "doc_id"))))
    lines = dealt(join_broken(lines).select("doc_id", "pos", X.fix_typos(X.close_spaces(F.col("line"))).alias("line")))
    lines = compact_blanks(dedup_within(renumber(dealt(clean_tables(lines)))))
    return to_text(compact_blanks(dedup_sentences(lines, deals=deals).drop("dropped")))
