"""Near-duplicate texts by the Jaccard similarity of their word shingles, through adaptive multi-match prefixes.

Every text is the set of its distinct 5-word shingles (A-Z lower-cased, words split at ASCII white space; a text
of fewer words is one shingle of all its words; a text without words, or null, has no shingle and links with nothing).
Two texts link when ``100 * |A & B| >= 80 * |A | B|``, whole sets compared.

How the work is kept linear in the input, while no link between different sets is lost:

1. Rows with equal sets are one class; only classes are joined.
2. Shingles get one global order, rarest first. The rarity comes from a sketch of fixed size over a sixteenth of the
   distinct texts; it only steers cost, since any global order gives the same links.
3. A class of n shingles keeps a prefix of ``n - ceil(0.8 n) + l`` of them. Linked classes share at least
   ``min(l, l')`` prefix shingles. ``l`` is chosen per class: a longer prefix costs more postings, but a candidate must
   then share more of them; the sketch's document frequencies price both.
4. Postings with a shingle of one class only are dropped. Then each list is joined with its centre alone, the class
   with the largest shared part: as many pairs as postings. Classes so linked fall into components.
5. Lists that hold one component only are dropped. A class in long lists that are left gets a pivot, one centre of its
   lists that covers half of it, and its overlap with the pivot is taken from the whole sets. Two classes with the same pivot share at most
   the smaller of both overlaps within it. Where that is less than they need to link, they must share shingles that the
   pivot lacks, so they only meet in lists keyed by pivot and such a shingle. Near copies of one text have few of these
   in common, so a long list gives no square of pairs.
6. All other pairs of different components meet in the lists by shingle. Pairs with enough shared shingles are compared
   in full.

Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textkit
from corpusloom.llm.components import components
from corpusloom.llm.scratch import Scratch

WORDS = 5
PERCENT = 80
#: Cells of the rarity sketch; a cell holds the largest count of its shingles. This bounds what is broadcast.
CELLS = 1 << 20
#: Only so many of the most frequent shingles enter the sketch, so most cells stay free however large the input is.
SKETCHED = CELLS // 4
#: One distinct text in so many feeds the sketch.
SKETCH_ONE_IN = 16
#: Prefixes are lengthened by up to so many shingles, less one.
MOST_MATCHES = 8
#: Comparing two sets costs as much as reading so many postings.
VERIFY_COST = 8.0
#: Up to so many ids of texts to compare are broadcast to the scan; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Keys from here on stand for rows whose id is null or repeated.
ODD = 1 << 62
#: Lists of so many classes give their classes a pivot. This steers cost only; links are the same for any length.
LONG_LIST = 16

_TOKEN_BITS = np.uint64(4)


def shingles(part: textkit.Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, 60-bit hash) of the distinct shingles of each text, sorted by row and hash."""
    word, per_row = part.hashes(lower=True), part.counts()
    ends = np.cumsum(per_row)
    grams = np.maximum(per_row - words + 1, np.minimum(per_row, 1))
    row = np.repeat(np.arange(part.rows), grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(ends - per_row, grams)
    left = np.repeat(ends, grams)
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    total = np.zeros(len(row), np.uint64)
    for k in range(words):
        total = total * np.uint64(0x2545F4914F6CDD1D) + np.where(at + k < left, padded[at + k], np.uint64(k + 1))
    h = textkit.mix(total) >> _TOKEN_BITS
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _cell(h: np.ndarray) -> np.ndarray:
    return (textkit.mix(h) & np.uint64(CELLS - 1)).astype(np.int64)


def _sketch(docs: DataFrame, words: int, scratch: Scratch) -> np.ndarray:
    """Per cell, the rarity class 0-15 of its most frequent shingle: the logarithm of its estimated document frequency."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.texts(textkit.text_column(batch)):
                _, h = shingles(part, words)
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    # Exact copies are all in the sample or all out of it, and count once.
    sample = docs.select("text").where(f"pmod(xxhash64(text), {SKETCH_ONE_IN}) = 3").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    size = F.least(F.floor(F.log2("n")) + 1, F.lit(15)).cast("long")
    counts = sample.select("text").mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 2").select("token", size.alias("size"))
    counts, least, held = scratch.save(counts, "counts"), 16, 0
    for r in sorted(counts.groupBy("size").count().collect(), reverse=True):
        held += r["count"]
        if held <= SKETCHED:
            least = r["size"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_cell(batch.column(0).to_numpy().astype(np.uint64))), batch.column(1)], ["cell", "size"])

    seen = counts.where(F.col("size") >= least).mapInArrow(cells, "cell long, size long").groupBy("cell").agg(F.max("size").alias("size")).toArrow()
    scratch.drop("counts")
    out = np.zeros(CELLS, np.uint8)
    out[seen.column("cell").to_numpy()] = seen.column("size").to_numpy()
    return out


def _needed(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n can have with one it links with."""
    return (n * PERCENT + 99) // 100


def _prefixes(sketch, words: int):
    """Rows (key, doc_id, set_hi, set_lo, n, l, prefix): set hash, size, matches asked for, and the prefix in the global order.

    Within a task only the first row of equal sets carries a prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, seen = sketch.value, set()
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for part in textkit.texts(textkit.text_column(batch)):
                row, h = shingles(part, words)
                n = np.bincount(row, minlength=part.rows)
                start = np.cumsum(n) - n
                full = n > 0
                lo, hi = np.zeros(part.rows, np.uint64), np.zeros(part.rows, np.uint64)
                if len(h):
                    lo[full] = np.add.reduceat(textkit.mix(h), start[full])
                    hi[full] = np.add.reduceat(textkit.mix(h ^ np.uint64(0x5851F42D4C957F2D)), start[full])
                size = rarity[_cell(h)]
                key = (size.astype(np.uint64) << np.uint64(60)) | h
                order = np.argsort(key)
                order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
                h, size = h[order], size[order]
                frequency = np.where(size == 0, 0.0, SKETCH_ONE_IN * np.exp2(size.astype(np.float64) - 1))
                sums = np.concatenate([[0.0], np.cumsum(frequency)])
                base = n - _needed(n)
                best, l = np.full(part.rows, np.inf), np.ones(part.rows, np.int64)
                for k in range(1, MOST_MATCHES + 1):
                    to = np.minimum(base + k, n)
                    others = sums[start + to] - sums[start]
                    cost = to + others + VERIFY_COST * others / k
                    better = (cost < best) & (base + k <= n)
                    best, l = np.where(better, cost, best), np.where(better, k, l)
                length = np.where(full, np.minimum(base + l, n), 0)
                for i in np.flatnonzero(full):
                    if (k := (int(lo[i]), int(n[i]))) in seen:
                        length[i] = 0
                    elif len(seen) < 1_000_000:
                        seen.add(k)
                take = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(part.first, part.rows), ids.slice(part.first, part.rows), *(pa.array(x.astype(np.int64)) for x in (hi, lo, n)), pa.array(l.astype(np.int32)), textkit.list_array(h[take].astype(np.int64), length)],
                    ["key", "doc_id", "set_hi", "set_lo", "n", "l", "prefix"],
                )

    return run


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted shingles of each text."""
    for part in textkit.texts(column):
        row, h = shingles(part, words)
        yield from np.split(h, np.cumsum(np.bincount(row, minlength=part.rows))[:-1])


def _compared(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, left set, right set, which of the left are in the right) of each pair of texts in the last two columns."""
    # Equal centres come as one shared text: each distinct text is cut once.
    right = batch.column(3).dictionary_encode()
    of = list(_sets(right.dictionary, words))
    for i, (k, mine) in enumerate(zip(right.indices.to_numpy(), _sets(batch.column(2), words), strict=True)):
        other = of[k]
        yield i, mine, other, other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine if len(other) else np.zeros(len(mine), bool)


def _links(mine: np.ndarray, other: np.ndarray, both: int) -> bool:
    return both > 0 and 100 * both >= PERCENT * (len(mine) + len(other) - both)


def _verify(words: int):
    """Keep the pairs of texts (a, b, text_a, text_b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, mine, other, shared in _compared(batch, words):
                keep[i] = _links(mine, other, int(shared.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _measure(sketch, words: int):
    """Rows (a, b, n, overlap, linked, extra) for pairs (a, pivot b, text_a, text_b); extra: what b lacks, in the global order.

    Classes of which the pivot covers less than half go without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sketch.value
        for batch in batches:
            n, overlap, linked, parts, keep = [], [], [], [], []
            for _, mine, other, shared in _compared(batch, words):
                both, extra = int(shared.sum()), mine[~shared]
                keep.append(2 * both >= len(mine))
                if not keep[-1]:  # too far from its pivot to gain by it
                    extra = extra[:0]
                parts.append(extra[np.argsort((rarity[_cell(extra)].astype(np.uint64) << np.uint64(60)) | extra)])
                n.append(len(mine)), overlap.append(both), linked.append(_links(mine, other, both))
            flat = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(overlap, pa.int64()), pa.array(linked, pa.bool_()), textkit.list_array(flat, np.array([len(x) for x in parts], np.int64))],
                ["a", "b", "n", "overlap", "linked", "extra"],
            ).filter(pa.array(keep, pa.bool_()))

    return run


def _with_texts(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(a, b, text_a, text_b)`` for pairs ``(a, b)`` of keys. Keys go to the scan; only the texts asked for are shuffled."""
    pairs = scratch.save(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    ids = scratch.save(ids, f"{name}-ids")
    found = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "key", "left_semi")
    found = scratch.save(found.select("key", "text"), f"{name}-texts")
    odd = found.where(F.col("key") >= ODD)
    if not odd.isEmpty():  # repeated rows share a key
        found = found.where(F.col("key") < ODD).unionByName(odd.dropDuplicates(["key"]))
    left = found.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = found.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")


def _linked(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, words: int) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose texts link."""
    both = _with_texts(pairs, docs, scratch, name)
    out = scratch.save(both.mapInArrow(_verify(words), "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-texts")
    return out


def _mixed(postings: DataFrame, keys: list[str]) -> DataFrame:
    """The postings of lists that hold more than one component."""
    found = postings.groupBy(*keys).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x <> y")
    return postings.join(found.drop("x", "y"), keys)


#: The overlap that two sets of n_a and n_b need: 0.8 / 1.8 of both sizes, rounded up.
_NEED = f"cast(({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT} as long)"
_SIZES = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"


def _lists(posting: DataFrame, component: DataFrame | None) -> DataFrame:
    """The postings of lists with more than one component, with what the filters of pairs ask for.

    m: the prefix shingles that a class can share with another component; rest: its shingles behind the prefix.
    """
    now = posting.withColumn("component", F.col("id"))
    if component is not None:
        now = posting.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    now = _mixed(now, ["token"])
    base = f"(n - cast((n * {PERCENT} + 99) div 100 as long))"
    now = now.join(now.groupBy("id").agg(F.count("*").alias("m")), "id").withColumn("rest", F.expr(f"n - least({base} + l, n)"))
    return now.select("token", "id", "n", "l", "m", "rest", "component", "members")


#: The prefix shingles that a pair must share. What lies behind the shorter-reaching prefix can add its rest at most.
_IN_PREFIX = f"greatest({_NEED} - greatest(rest_a, rest_b), least(l_a, l_b))"
_FITS = f"component_a <> component_b and {_SIZES} and least(m_a, m_b) >= {_IN_PREFIX}"


def _sides(postings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    a, b = (postings.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in postings.columns if c not in keys)) for s in "ab")
    return a, b


def _centres(now: DataFrame) -> DataFrame:
    """Per list its centre: the class whose live part is largest, ties to the least id."""
    chosen = F.expr("max_by(struct(id, n, l, m, rest, component), struct((m + rest) / n, -id))")
    return now.groupBy("token").agg(chosen.alias("c"))


def _counted(pairs: DataFrame, asked: str) -> DataFrame:
    """``(a, b, c, need)``: how often each pair meets, and how often it must."""
    return pairs.groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(F.count("*").alias("c"), F.first(F.expr(asked)).alias("need"))


def _star_pairs(now: DataFrame) -> DataFrame:
    """Pairs of each list's centre with the others. A star sees a part of what its pairs share and need not find every link."""
    centre = _centres(now).select("token", *(F.col(f"c.{c}").alias(f"{c}_a") for c in ("id", "n", "l", "m", "rest", "component")))
    pairs = centre.join(_sides(now, ["token"])[1], "token").where(_FITS)
    return _counted(pairs, _IN_PREFIX).where("2 * c >= need").select("a", "b")


def _pivots(now: DataFrame) -> DataFrame:
    """``(a, b)``: classes with their pivot, the best centre of their long lists, where it is that of a quarter of their lists."""
    long = now.where(F.col("members") >= LONG_LIST)
    centre = _centres(long).select("token", F.col("c.id").alias("pivot"), F.expr("struct((c.m + c.rest) / c.n, -c.id)").alias("rank"))
    met = long.join(centre, "token").groupBy("id", "pivot").agg(F.count("*").alias("c"), F.max("m").alias("m"), F.max("rank").alias("rank"))
    best = met.groupBy("id").agg(F.max_by(F.struct("pivot", "c", "m"), "rank").alias("p"))
    return best.where("4 * p.c >= p.m").select(F.col("id").alias("a"), F.col("p.pivot").alias("b"))


def _pairs_by_token(now: DataFrame, beyond: DataFrame) -> DataFrame:
    """Pairs that meet often enough in the lists by shingle, but for those that the lists by pivot see."""
    of = beyond.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "overlap")
    a, b = _sides(now.drop("members").join(of, "id", "left"), ["token"])
    apart = f"not (pivot_a is not null and pivot_b is not null and pivot_a = pivot_b and least(overlap_a, overlap_b) < {_NEED})"
    pairs = a.join(b, "token").where(f"id_a < id_b and {_FITS} and {apart}")
    return _counted(pairs, _IN_PREFIX).where("c >= need").select("a", "b")


def _beyond(measured: DataFrame) -> DataFrame:
    """The measured classes as against their pivot and the shingles beyond it that half its classes have: what such
    classes share of these is at most the smaller of both overlaps too. ``extra`` loses them, ``overlap`` gains them.

    No partner is smaller than 0.8 of a set, so no pair needs less than 0.8 of it; two classes that must share e or more
    of their extras share one of the first size - e + 1 of either, so extra loses its last ``rest``.
    """
    held = measured.select("b", F.explode("extra").alias("token")).groupBy("b", "token").agg(F.count("*").alias("held"))
    of = measured.groupBy("b").agg(F.count("*").alias("classes")).where(F.col("classes") > 2)
    common = held.join(of, "b").where("2 * held >= classes").groupBy("b").agg(F.collect_set("token").alias("common"))
    left = F.when(F.col("common").isNull(), F.col("extra")).otherwise(F.array_except("extra", "common"))
    out = measured.join(common, "b", "left").withColumn("left", left)
    out = out.select("a", "b", "n", F.expr("overlap + size(extra) - size(left)").alias("overlap"), F.size("left").cast("long").alias("extras"), "left")
    kept = f"cast(greatest(0, extras - greatest(0, (n * {PERCENT} + 99) div 100 - overlap - 1)) as int)"
    return out.select("a", "b", "n", "overlap", "extras", F.expr(f"extras - {kept}").alias("rest"), F.expr(f"slice(left, 1, {kept})").alias("extra"))


def _pairs_by_pivot(beyond: DataFrame, component: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of one pivot that must share shingles beyond it, and share enough of them."""
    posting = beyond.join(component.withColumnRenamed("id", "a"), "a", "left").select(
        F.col("a").alias("id"), F.col("b").alias("pivot"), "n", "overlap", "extras", "rest", F.coalesce("component", "a").alias("component"), F.explode("extra").alias("token"),
    )
    now = scratch.save(_mixed(posting, ["pivot", "token"]).drop("members"), "pivot-mixed")
    now = scratch.save(now.join(now.groupBy("pivot", "id").agg(F.count("*").alias("m")), ["pivot", "id"]), "pivot-lists")
    a, b = _sides(now, ["pivot", "token"])
    more = f"({_NEED} - least(overlap_a, overlap_b))"
    asked = f"greatest({more} - greatest(rest_a, rest_b), 1)"
    pairs = a.join(b, ["pivot", "token"]).where(f"id_a < id_b and component_a <> component_b and {_SIZES} and {more} between 1 and least(extras_a, extras_b) and least(m_a, m_b) >= {asked}")
    return _counted(pairs, asked).where("c >= need").select("a", "b")


def _keyed(docs: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """``docs`` with a key that tells texts apart: the id, or for null and repeated ids ODD and above, by a hash of id and text."""
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(f"{key}_id")).agg(F.count("*").alias("n")).where("n > 1")
    again = scratch.save(again.select(f"{key}_id", F.lit(True).alias(f"{key}_again")), "repeated")
    few = again.count()
    odd = F.lit(ODD) + F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text")), 2)
    if not few:
        return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), odd))
    docs = docs.join(F.broadcast(again) if few <= BROADCAST_IDS else again, F.col("doc_id").cast("long") == F.col(f"{key}_id"), "left")
    return docs.withColumn(key, F.when(F.col("doc_id").isNull() | F.col(f"{key}_again"), odd).otherwise(F.col("doc_id").cast("long"))).drop(f"{key}_id", f"{key}_again")


def _components(docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """``(key, doc_id, n, component)`` per row of ``docs(key, doc_id, text)``; component is the least key that links reach."""
    spark: SparkSession = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, words, scratch))
    rows = scratch.save(docs.select("key", "doc_id", "text").mapInArrow(_prefixes(sketch, words), "key long, doc_id long, set_hi long, set_lo long, n long, l int, prefix array<long>"), "prefixes")
    member = rows.select("key", "doc_id", "n", "set_hi", "set_lo", "l")
    classes = scratch.save(member.where("n > 0").groupBy("set_hi", "set_lo", "n").agg(F.min("key").alias("id"), F.max("l").alias("l")), "classes")

    # Postings by class. A class cut in several tasks comes several times, which min and max don't mind.
    posting = rows.select("set_lo", "n", F.explode("prefix").alias("token"))
    several = posting.groupBy("token").agg(F.min("set_lo").alias("least"), F.max("set_lo").alias("most")).where("least <> most").select("token")
    posting = posting.join(several, "token").distinct().join(classes.select("set_lo", "n", "id", "l"), ["set_lo", "n"]).select("token", "id", "n", "l")
    posting = scratch.save(posting, "postings")

    now = scratch.save(_lists(posting, None), "lists-0")
    links = _linked(_star_pairs(now), docs, scratch, "stars", words)
    component = components(links, scratch, "components-0")
    scratch.drop("lists-0")
    now = scratch.save(_lists(posting, component), "lists-1")
    schema = "a long, b long, n long, overlap long, linked boolean, extra array<long>"
    measured = scratch.save(_with_texts(_pivots(now), docs, scratch, "pivots").mapInArrow(_measure(sketch, words), schema), "measured")
    links = links.union(measured.where("linked").select("a", "b"))
    component = components(links, scratch, "components-1")
    scratch.drop("lists-1")
    now = scratch.save(_lists(posting, component), "lists-2")
    beyond = scratch.save(_beyond(measured), "beyond")
    pairs = _pairs_by_token(now, beyond).union(_pairs_by_pivot(beyond, component, scratch)).distinct()
    links = links.union(_linked(pairs, docs, scratch, "last", words))
    component = components(links, scratch, "components-2")
    for name in ("postings", "lists-2", "measured", "beyond", "pivot-mixed", "pivot-lists"):
        scratch.drop(name)

    reach = classes.join(component, "id", "left").select("set_hi", "set_lo", "n", F.coalesce("component", "id").alias("component"))
    return member.join(reach, ["set_hi", "set_lo", "n"], "left").select("key", "doc_id", "n", F.coalesce("component", "key").alias("component"))


def near_duplicate_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, the row's own included. Ties (equal sets, equal frequencies)
    are broken by hash and id, so a rerun gives the same rows. An empty table gives an empty result. Rows with a null or a
    repeated id are told apart by their texts; component_id is null where no row that is reached has an id. Ids are below 2**62.
    """
    scratch = Scratch(docs.sparkSession)
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch, "key")
    found = scratch.save(_components(docs, words, scratch), "found")
    odd = scratch.save(found.where(F.col("key") >= ODD).groupBy("component").agg(F.min("doc_id").alias("least")), "odd")
    own = F.when(F.col("component") < ODD, F.col("component"))
    return found.join(odd, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.least(own, "least").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all columns; rows without shingles stay.

    The first has the smallest id; rows with null or repeated ids come after all others, in the order of a hash.
    """
    scratch, key = Scratch(docs.sparkSession), "_key"
    while any(c.startswith(key) for c in docs.columns):
        key += "_"
    keyed = _keyed(docs, scratch, key)
    found = _components(keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), WORDS, scratch)
    own = f"{key}_kept"
    kept = scratch.save(found.where("component = key").groupBy(F.col("key").alias(own)).agg(F.max("n").alias(f"{key}_n")), "kept")
    several = (F.col(own) >= ODD) & (F.col(f"{key}_n") > 0)
    out = keyed.join(kept.where(~several), F.col(key) == F.col(own), "left_semi")
    if not kept.where(several).isEmpty():
        out = out.unionByName(keyed.join(kept.where(several), F.col(key) == F.col(own), "left_semi").dropDuplicates([key]))
    return out.drop(key)
