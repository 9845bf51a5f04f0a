"""A hierarchical Pitman-Yor model of words, seated by Gibbs sweeps, and the log probability of texts under it.

Tokens are words (split at ASCII white space, A-Z lower-cased) and one end per text; before the first word stands an end.
The root restaurant serves words; each context restaurant, one per preceding token, has the root as its parent.
A context's customers are the tokens after it. Each table there sends one customer to the root, whose base is uniform
over the known words and one unknown word.

Every context and every dish seen is kept, as rows of stored tables. Only what is looked up in the task is bounded: the HEAD most frequent
words (also as contexts) and dishes. All others are joined by a shuffle, so the model is the same whatever the size of its heads.

Disk: pairs are counted in COUNT_SLICES slices of contexts and documents scored in SCORE_SLICES slices of ids, one after the other, so
that only one slice's shuffle lies on disk at a time. Dishes are stored in buckets of their key, words in buckets of their hash: no join
shuffles them again. Pairs travel and lie as lists of numbers, a row for each bucket of keys, BUCKETS times as many as a shuffle has partitions,
and are summed and looked up a bucket at a time. Joins hash the vocabulary's side, which grows less than the partitions do; others hash a side
only if Spark finds each of its partitions below HASHED, and else sort. Nothing that grows with the corpus is broadcast.

A sweep seats each dish anew, given the other restaurants' tables from the last sweep: dishes then don't depend on each
other, so they are sampled where they lie. Seating goes customer by customer up to SINGLES, then in blocks of a sixteenth of those
seated. Chance comes from the dish's key, the sweep and the customer's number alone, so neither partitions nor a task's second try change a seat.
A dish of one customer always has one table, so only its number takes part; so does a word of one occurrence, which joins in the last sweep.
A word's count in the root follows from its tables.
Predictive probabilities are averaged over the last two sweeps; perplexity is 10 to the negative mean log10 probability of a token.

Counts cover every training token. A null or empty text is its end alone. A null id counts as the empty id. Repeated
rows count each time. Without training rows each token has the probability of the unknown word, 1. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textkit
from corpusloom.llm.scratch import Scratch

#: Words and dishes looked up in the task; the others are joined.
HEAD = 1 << 19
SWEEPS = 3
SINGLES = 16
STRENGTH = 1.0
SEED = 20240229
#: A block's tables are drawn from a normal distribution if their variance is larger.
NORMAL = 100
#: A join hashes a side rather than sort both if none of its partitions is larger.
HASHED = "64m"
#: Slices of contexts and of documents that are counted and scored one after the other.
COUNT_SLICES = 2
SCORE_SLICES = 3
#: Buckets of keys for each partition of a shuffle.
BUCKETS = 2
#: Rows seated at once: each step of the seating costs a call, however few are left in it.
SEATED = 1 << 16
#: Texts whose sums are put together in one group, as a power of two.
PART_BITS = 14

END = np.uint64(0x0E0D0E0D0E0D0E0D)
_COMPACT = 3_000_000
_STRIDE = 0x9E3779B97F4A7C15
#: Counts beyond are told apart no further when heads are cut.
_MOST = 1 << 20


def tokens(part: textkit.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each token of a slice: the words of each text, then its end."""
    per = part.counts() + 1
    row = np.repeat(np.arange(part.rows), per)
    h = np.full(len(row), END, np.uint64)
    last = np.cumsum(per) - 1
    word = np.ones(len(row), bool)
    word[last] = False
    h[word] = part.hashes(lower=True)
    return row, h


def before(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The token before each, an end before the first."""
    out = np.empty_like(h)
    if len(h):
        out[0], out[1:] = END, h[:-1]
    return out


def dish_key(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One key for a word in a context, both hashes: the word's hash against the context's with its halves exchanged."""
    u = u.astype(np.uint64)
    return h ^ (u << np.uint64(32) | u >> np.uint64(32))


def _swapped(u: Column) -> Column:
    return F.shiftleft(u, 32).bitwiseOR(F.shiftrightunsigned(u, 32))


def _summed(k: np.ndarray, u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n by k, which tells u."""
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], u[order][first], np.add.reduceat(n[order], first) if len(k) else n


def _flat(rows: pa.Table | pa.RecordBatch, name: str, kind: type = np.int64) -> np.ndarray:
    """The numbers of a column of packed lists, one list after the other."""
    column = rows.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of numbers as the bytes they have in memory: Spark then moves and stores them without a look at each."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * values.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _lists(k: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """The buckets of sorted keys, and for the keys and each column a list a bucket; a bucket is a range of keys."""
    b = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(first, len(b)))
    return pa.array(b[first]), [_packed(c, lengths) for c in (k, *columns)]


def _counter(at: int, buckets: int):
    """Lists k, u, n for each bucket b of what a task reads: the dishes of the contexts of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                k, u, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held[:] = [(k, u, n)]
                if len(k) > _COMPACT // 2 or last:
                    held.clear()
                    b, lists = _lists(k, buckets, u, n)
                    yield pa.RecordBatch.from_arrays([b, *lists], ["b", "k", "u", "n"])

        size, last = 0, False
        for batch in batches:
            for part in textkit.texts(textkit.text_column(batch)):
                row, h = tokens(part)
                u = before(row, h)
                here = (u >> np.uint64(40)) % np.uint64(COUNT_SLICES) == at
                u, h = u[here], h[here]
                held.append(_summed(dish_key(u, h), u, np.ones(len(h), np.int64)))
                size += len(held[-1][1])
            if size > _COMPACT:
                yield from out()
                size = sum(len(x[1]) for x in held)
        last = True
        yield from out()

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """One row for a bucket: key and context of dishes of one customer (k1, u1; ones of them), and those of the others with their customers."""
    k, u, n = _summed(_flat(rows, "k", np.uint64), _flat(rows, "u"), _flat(rows, "n"))
    one = n == 1
    lists = {name: _packed(x, np.array([len(x)])) for name, x in (("k1", k[one]), ("u1", u[one]), ("k", k[~one]), ("u", u[~one]), ("c", n[~one]))}
    return pa.table({"b": rows.column("b")[:1], "ones": pa.array([int(one.sum())]), **lists})


def _of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each context in a batch: customers, dishes of one customer, dishes."""
    for b in batches:
        single, c = _flat(b, "u1"), _flat(b, "c")
        u, c = np.concatenate([single, _flat(b, "u")]), np.concatenate([np.ones(len(single), np.int64), c])
        order = np.argsort(u)
        u, c = u[order], c[order]
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x, first) if len(u) else c for x in (c, (c == 1).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u[first], *sums, np.diff(np.append(first, len(u))))], ["h", "c", "ones", "of"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many dishes of a batch have c customers."""
    for b in batches:
        c, n = np.unique(_flat(b, "c"), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(1, c)), pa.array(np.append(b.column("ones").to_numpy().sum(), n))], ["c", "n"])


def _repeated(words: np.ndarray):
    """The dishes of two customers and more as rows; met if the head has word and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, u, c = _flat(b, "k", np.uint64), _flat(b, "u", np.uint64), _flat(b, "c")
            h, one = dish_key(u, k), np.ones(len(c), np.int64)
            met = (find(words, u) >= 0) & (find(words, h) >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u.view(np.int64), h.view(np.int64), c, one, one, met)], ["u", "h", "c", "t", "tp", "met"])

    return run


def _masses(buckets: int):
    """Lists of the keys and masses of rows of dishes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, m = batch.column("k").to_numpy().view(np.uint64), batch.column("m").to_numpy()
            order = np.argsort(k)
            b, lists = _lists(k[order], buckets, m[order])
            yield pa.RecordBatch.from_arrays([b, *lists], ["b", "k", "m"])

    return run


def _with_masses(once: float):
    """The masses of all dishes of a bucket, sorted by key: ``once`` for those of one customer."""

    def run(pairs: pa.Table, dishes: pa.Table) -> pa.Table:
        k = np.sort(np.concatenate([_flat(pairs, "k1", np.uint64), _flat(pairs, "k", np.uint64)]))
        m = np.full(len(k), once, np.float32)
        m[find(k, _flat(dishes, "k", np.uint64))] = _flat(dishes, "m", np.float32)
        one = np.array([len(k)])
        return pa.table({"b": pairs.column("b")[:1], "k": _packed(k, one), "m": _packed(m, one)})

    return run


def _asked(row: np.ndarray, k: np.ndarray, n: np.ndarray, per: np.ndarray, buckets: int) -> Iterator[list]:
    """Arrays b, rows, k, n, per: lists of the dishes that texts ask of a bucket, each with its text's row."""
    order = np.argsort(k)
    b, (keys, *others) = _lists(k[order], buckets, row[order], n[order], per[order])
    yield [b, others[0], keys, *others[1:]]


_ASKED = ["b", "rows", "k", "n", "per"]
_ASKED_TYPES = "b int, rows binary, k binary, n binary, per binary"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, m) of lists of masses."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_flat(b, "k")), pa.array(_flat(b, "m", np.float32))], ["k", "m"])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at least, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held.clear()
    if held:
        yield pa.concat_batches(held)


def _asking(buckets: int):
    """Rows (row, k, n, per) as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, _COMPACT // 2):
            row, k, n, per = (b.column(i).to_numpy() for i in range(4))
            for arrays in _asked(row, k.view(np.uint64), n, per, buckets):
                yield pa.RecordBatch.from_arrays(arrays, _ASKED)

    return run


def _look_up(asked: pa.Table, masses: pa.Table) -> pa.Table:
    """What the dishes of a bucket add to the scores of the texts that ask for them."""
    dish = find(_flat(masses, "k", np.uint64), _flat(asked, "k", np.uint64))
    here = dish >= 0
    mass = _flat(masses, "m", np.float32)[dish[here]].astype(np.float64)
    s = _flat(asked, "n", np.int32)[here] * np.log1p(mass * _flat(asked, "per", np.float32)[here]) / math.log(10)
    row, inverse = np.unique(_flat(asked, "rows")[here], return_inverse=True)
    sums = np.bincount(inverse, s, len(row)).astype(np.float64)
    part, found = np.unique(row >> PART_BITS, return_counts=True)
    return pa.table({"part": part, "at": _packed((row & ((1 << PART_BITS) - 1)).astype(np.int32), found), "s": _packed(sums, found)})


def _sums(rows: pa.Table) -> pa.Table:
    """The sums of a part's texts, from all buckets."""
    at = _flat(rows, "at", np.int32)
    sums, here = np.bincount(at, _flat(rows, "s", np.float64)).astype(np.float64), np.flatnonzero(np.bincount(at))
    return pa.table({"row": (rows.column("part")[0].as_py() << PART_BITS) + here, "score2": sums[here]})


def find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def draws(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1), one per key, that hang on the key and the step alone."""
    return (textkit.mix(keys + np.uint64(_STRIDE * step % (1 << 64))) >> np.uint64(11)) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, step: int) -> np.ndarray:
    """Successes of n trials each: the least k whose distribution passes the draw; normal where the variance passes NORMAL."""
    u, odd = draws(keys, 2 * step), p > 0.5
    q = np.where(odd, 1 - p, p)
    k, wide = np.zeros(len(n), np.int64), n * q * (1 - q) > NORMAL
    if wide.any():
        a, b, mean = u[wide], draws(keys[wide], 2 * step + 1), (n * q)[wide]
        z = np.sqrt(-2 * np.log1p(-a)) * np.cos(2 * np.pi * b)
        k[wide] = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - q[wide]))), 0, n[wide])
    at = np.flatnonzero(~wide)
    share = (1 - q[at]) ** n[at]
    left = u[at] - share
    while len(at := at[(on := (left >= 0) & (k[at] < n[at]))]):
        share = share[on] * (n[at] - k[at]) / (k[at] + 1) * (q[at] / (1 - q[at]))
        left = left[on] - share
        k[at] += 1
    return np.where(odd, n - k, k)


def seat(c: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers each: a customer opens one with odds of weight to seated - discount * tables."""
    t = np.minimum(c, 1)
    order = np.argsort(-c, kind="stable")
    falling = c[order]
    i = 1
    while True:
        live = order[: int(np.searchsorted(-falling, -i, "left"))]  # more than i customers
        if not len(live):
            return t
        block = max(1, i // SINGLES)
        w = weight[live]
        p = np.clip(w / (w + np.maximum(i - discount * t[live], 1e-9)), 0, 1)
        t[live] += draws(keys[live], 2 * i) < p if block == 1 else binomial(np.minimum(block, c[live] - i), p, keys[live], i)
        i += block


@dataclass
class Heads:
    """What a task looks up: frequent words, contexts and dishes, with the sweeps' figures side by side."""

    words: np.ndarray
    counts: np.ndarray
    root: np.ndarray
    contexts: np.ndarray
    back: np.ndarray
    dishes: np.ndarray
    mass: np.ndarray
    total: int
    types: int


def _keys(of: np.ndarray, sweep: int, level: int) -> np.ndarray:
    """Keys of a sweep's draws for dishes (level 1) or words (level 0)."""
    return textkit.mix(of ^ textkit.mix(np.array([SEED + 2 * sweep + level], np.uint64)))


@contextmanager
def _hashed_joins(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before_it = spark.conf.get(name)
    spark.conf.set(name, HASHED)
    try:
        yield
    finally:
        spark.conf.set(name, before_it)


def _shape(counts: DataFrame) -> tuple[int, float]:
    """The least count that at most HEAD reach, and the discount, of rows with count c, n of each."""
    rows = counts.groupBy(F.least("c", F.lit(_MOST)).alias("c")).agg(F.sum("n").alias("n")).collect()
    n = {r["c"]: r["n"] for r in rows}
    least, held = _MOST + 1, 0
    for c in sorted(n, reverse=True):
        held += n[c]
        if held > HEAD:
            break
        least = c
    n1, n2 = n.get(1, 0), n.get(2, 0)
    return least, min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _root_column(seated: str, tables: str, totals: tuple[float, float], types: int, discount: float) -> Column:
    """As _root; a word without a row has no customers."""
    own = F.greatest(F.coalesce(F.col(seated) - F.lit(discount) * F.col(tables), F.lit(0.0)), F.lit(0.0))
    return (own + (STRENGTH + discount * totals[1]) / (types + 1)) / (STRENGTH + totals[0])


def _unsigned(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy().astype(np.int64).view(np.uint64)


def _root(customers: np.ndarray, tables: np.ndarray, totals: tuple[float, float], types: int, discount: float) -> np.ndarray:
    """Root probabilities; totals are all customers and all tables."""
    all_c, all_t = totals
    return (np.maximum(customers - discount * tables, 0) + (STRENGTH + discount * all_t) / (types + 1)) / (STRENGTH + all_c)


class Model:
    """Seatings of the last two sweeps: tables of words and of dishes, and the bounded heads."""

    def __init__(self, train: DataFrame) -> None:
        spark = train.sparkSession
        self.scratch, self.calls = Scratch(spark), 0
        scratch = self.scratch
        texts = train.select(F.col("text").cast("string"))
        self.buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        for at in range(COUNT_SLICES):
            counted = texts.mapInArrow(_counter(at, self.buckets), "b int, k binary, u binary, n binary").groupBy("b").applyInArrow(_add_up, "b int, ones long, k1 binary, u1 binary, k binary, u binary, c binary")
            pairs = scratch.save_by(counted, "pairs", "b", append=at > 0)
            del counted
            self._release()
        one = F.lit(1).cast("long")
        # At first every customer of the root sits with its like, and each dish has one table. A text's end stands before
        # its first word, so each token has as many customers after it as it has occurrences: pairs tell the words' counts.
        words = pairs.select("u1", "u", "c").mapInArrow(_of_words, "h long, c long, ones long, of long").groupBy("h").agg(*(F.sum(n).alias(n) for n in ("c", "ones", "of")))
        every = scratch.save_by(words.select("h", "c", "ones", "of", F.col("of").alias("of_p"), F.col("c").alias("seated"), one.alias("tables"), F.col("c").alias("seated_p"), one.alias("tables_p")), "state-0", "h")
        total, types, once = every.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
        self.total, self.types = total, types
        (self.least, d0), (least_dish, d1) = _shape(every.select("c", one.alias("n"))), _shape(pairs.select("ones", "c").mapInArrow(_sizes, "c long, n long"))
        self.d0, self.d1 = d0, d1
        totals = [(float(total), float(types))] * 2
        state = every.where("c > 1")
        known = np.sort(_unsigned(state.where(F.col("c") >= self.least).select("h").toArrow(), "h"))
        dishes = scratch.save(pairs.select("k", "u", "c").mapInArrow(_repeated(known), "u long, h long, c long, t long, tp long, met boolean"), "dishes-0")
        for sweep in range(1, SWEEPS + 1):
            p = _root_column("seated", "tables", totals[1], types, d0)
            found = state.where(F.col("c") >= self.least).select("h", p.alias("p"), "of").toArrow()
            order = np.argsort(_unsigned(found, "h"))
            head = spark.sparkContext.broadcast((known, *(found.column(n).to_numpy()[order] for n in ("p", "of"))))
            del found
            # Dishes of the head's words and contexts are seated where they lie, the others after joins.
            of = state.select(F.col("h").alias("u"), "of")
            at = dishes.where("not met").join(state.select("h", p.alias("p")).hint("shuffle_hash"), "h").join(of.hint("shuffle_hash"), "u")

            def seat_met(batches: Iterator[pa.RecordBatch], sweep: int = sweep, head=head) -> Iterator[pa.RecordBatch]:
                words, p, of = head.value
                for b in _gathered(batches, SEATED):
                    u, h, n, t = (b.column(i).to_numpy() for i in range(4))
                    u, h = u.view(np.uint64), h.view(np.uint64)
                    new = seat(n, (STRENGTH + d1 * np.maximum(of[find(words, u)] - t, 0)) * p[find(words, h)], d1, _keys(dish_key(u, h), sweep, 1))
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new.astype(np.int64)), b.column(3), b.column(5)], ["u", "h", "c", "t", "tp", "met"])

            def seat_dishes(batches: Iterator[pa.RecordBatch], sweep: int = sweep) -> Iterator[pa.RecordBatch]:
                for b in _gathered(batches, SEATED):
                    u, h, n, t, p, of = (b.column(i).to_numpy() for i in range(6))
                    keys = _keys(dish_key(u.view(np.uint64), h.view(np.uint64)), sweep, 1)
                    # The dish's own tables are taken off before it is seated anew.
                    new = seat(n.astype(np.int64), (STRENGTH + d1 * np.maximum(of - t, 0)) * p, d1, keys)
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new.astype(np.int64)), b.column(3), pa.array(np.zeros(len(n), bool))], ["u", "h", "c", "t", "tp", "met"])

            columns = "u long, h long, c long, t long, tp long, met boolean"
            met = dishes.where("met").mapInArrow(seat_met, columns)
            dishes = scratch.save(met.unionByName(at.select("u", "h", "c", "t", "p", "of").mapInArrow(seat_dishes, columns)), f"dishes-{sweep}")
            head.destroy()
            fewer = dishes.groupBy("h").agg(F.sum(F.col("c") - F.col("t")).alias("fewer"))
            more = dishes.groupBy(F.col("u").alias("h")).agg(F.sum("t").alias("more"))
            if last := sweep == SWEEPS:
                seated = [F.coalesce(n, one).alias(n) for n in ("of", "seated", "tables")]
                state = every.select("h", "c", "ones").join(state.select("h", "of", "seated", "tables").hint("shuffle_hash"), "h", "left").select("h", "c", "ones", *seated)
            given = state.join(fewer.hint("shuffle_hash"), "h", "left").join(more.hint("shuffle_hash"), "h", "left").select(
                "h", "c", "ones", (F.col("ones") + F.coalesce("more", F.lit(0))).alias("now_of"), "of", "seated", "tables", (F.col("c") - F.coalesce("fewer", F.lit(0))).alias("now"),
            )
            all_t = totals[1][1]

            def seat_words(batches: Iterator[pa.RecordBatch], sweep: int = sweep, all_t: float = all_t) -> Iterator[pa.RecordBatch]:
                for b in _gathered(batches, SEATED):
                    keys = _keys(b.column(0).to_numpy().view(np.uint64), sweep, 0)
                    now, tables = b.column(7).to_numpy(), b.column(6).to_numpy()
                    weight = (STRENGTH + d0 * np.maximum(all_t - tables, 0)) / (types + 1)
                    new = pa.array(seat(now.astype(np.int64), weight, d0, keys).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(7), new, b.column(5), b.column(6)], state_names)

            state_names = ["h", "c", "ones", "of", "of_p", "seated", "tables", "seated_p", "tables_p"]
            state = scratch.save_by(given.mapInArrow(seat_words, ", ".join(f"{n} long" for n in state_names)), f"state-{sweep}", "h")
            both = state.agg(F.sum("seated"), F.sum("tables")).first()
            alone = 0 if last else once
            totals = [totals[1], (float(both[0] or 0) + alone, float(both[1] or 0) + alone)]
            if sweep > 1:
                scratch.drop(f"state-{sweep - 1}")
            scratch.drop(f"dishes-{sweep - 1}")
            del at, met, fewer, more, given
            self._release()
        self.state, self.totals = state, totals
        # A dish's mass is (c - d1 tables) / (STRENGTH + customers of its context), here without the divisor.
        mass = dishes.select(_swapped(F.col("u")).bitwiseXOR(F.col("h")).alias("k"), (F.col("c") - d1 * (F.col("t") + F.col("tp")) / 2).cast("float").alias("m"))
        mass = mass.mapInArrow(_masses(self.buckets), "b int, k binary, m binary")
        mass = pairs.select("b", "k1", "k").groupBy("b").cogroup(mass.groupBy("b")).applyInArrow(_with_masses(1 - d1), "b int, k binary, m binary")
        self.masses = scratch.save_by(mass, "dishes", "b")
        self.dishes = self.masses.mapInArrow(_unpacked, "k long, m float")
        del mass
        found = state.where(F.col("c") >= self.least).toArrow()
        h = _unsigned(found, "h")
        order = np.argsort(h)
        h = h[order]
        f = {n: found.column(n).to_numpy()[order].astype(np.int64) for n in found.column_names if n != "h"}
        roots = np.stack([_root(f["seated_p"], f["tables_p"], totals[0], types, d0), _root(f["seated"], f["tables"], totals[1], types, d0)], 1)
        back = np.stack([(STRENGTH + d1 * f[n]) / (STRENGTH + f["c"]) for n in ("of_p", "of")], 1)
        rows = dishes.where(F.col("c") >= least_dish).toArrow()
        u, w = find(h, _unsigned(rows, "u")), _unsigned(rows, "h")
        here = (u >= 0) & (find(h, w) >= 0)
        n, t, tp = (rows.column(i).to_numpy()[here].astype(np.int64) for i in range(2, 5))
        u, w = u[here], w[here]
        key = dish_key(u, w)
        order = np.argsort(key)
        mass = (np.stack([n - d1 * tp, n - d1 * t], 1) / (STRENGTH + f["c"][u])[:, None])[order] if len(u) else np.zeros((0, 2))
        self.heads = Heads(h, f["c"], roots, h, back, key[order], mass, total, types)
        del found, rows
        for name in ("pairs", "state-0", f"dishes-{SWEEPS}"):
            scratch.drop(name)
        self._release()

    def _release(self) -> None:
        """Let Spark delete the shuffles of tables that are written: it does so once their plans are collected."""
        gc.collect()
        self.scratch.spark._jvm.System.gc()

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs(doc_id, held_out, text)`` without text, plus n_tokens, n_known, train_tokens, base_score, score and perplexity."""
        shared, buckets = docs.sparkSession.sparkContext.broadcast(self.heads), self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            log_all = np.log10(m.total + 0.5 * (m.types + 1))
            of_end = find(m.words, np.array([END]))
            held: list[tuple] = []
            size, base_row = 0, TaskContext.get().partitionId() << 33

            def out() -> Iterator[pa.RecordBatch]:
                for arrays in _asked(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets) if held else ():
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(arrays[0]), f.type) for f in fields), *arrays], [*(f.name for f in fields), *_ASKED])
                held.clear()

            fields: list[pa.Field] = []
            for batch in batches:
                for part in textkit.texts(batch.column(2)):
                    row, h = tokens(part)
                    key, inverse = np.unique(h, return_inverse=True)
                    w = find(m.words, key)[inverse]
                    v = np.append(of_end, w[:-1])
                    known = np.bincount(row[w >= 0], minlength=part.rows)
                    base = np.bincount(row[w >= 0], np.log10(m.counts[w[w >= 0]] + 0.5) - log_all, part.rows).astype(np.float64)  # integers, if nothing is here
                    both = np.flatnonzero((w >= 0) & (v >= 0))
                    dish = find(m.dishes, dish_key(v[both], h[both]))
                    here, dish = both[dish >= 0], dish[dish >= 0]
                    p = m.root[w[here]] * m.back[v[here]] + m.mass[dish] if len(here) else np.zeros((0, 2))
                    score = np.bincount(row[here], np.log10(p.mean(1)), part.rows).astype(np.float64)
                    # The rest by text, context and word: those of which the head knows word and context, and the others.
                    left = np.ones(len(h), bool)
                    left[here] = False
                    u = before(row, h)
                    r, u, x, w, v = row[left], u[left], h[left], w[left], v[left]
                    k = dish_key(u, x)
                    in_text = textkit.mix(k + (r + 1).astype(np.uint64) * np.uint64(_STRIDE))
                    order = np.argsort(in_text)
                    in_text = in_text[order]
                    first = np.flatnonzero(np.append(True, in_text[1:] != in_text[:-1])) if len(k) else np.zeros(0, np.int64)
                    n = np.diff(np.append(first, len(k))).astype(np.int32)
                    at = order[first]
                    order = np.argsort(r[at], kind="stable")
                    at, n = at[order], n[order]
                    k, r, u, x, w, v = k[at], r[at], u[at], x[at], w[at], v[at]
                    near = (w >= 0) & (v >= 0)
                    a = (m.root[w[near]] * m.back[v[near]]).mean(1) if near.any() else np.zeros(0)
                    score += np.bincount(r[near], n[near] * np.log10(a), part.rows)
                    per = 1 / ((m.counts[v[near]] + STRENGTH) * a)

                    def lists(group: np.ndarray, columns: list, names: list[str], rows: int = part.rows) -> pa.Array:
                        ends = np.append(0, np.cumsum(np.bincount(group, minlength=rows))).astype(np.int32)
                        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in columns], names))

                    held.append((base_row + r[near], k[near], n[near], per.astype(np.float32)))
                    size += len(per)
                    rare = lists(r[~near], [k[~near].view(np.int64), n[~near], u[~near].view(np.int64), x[~near].view(np.int64)], ["k", "n", "u", "h"])
                    texts = pa.RecordBatch.from_arrays([
                        batch.column(0).slice(part.first, part.rows), batch.column(1).slice(part.first, part.rows), pa.array(np.bincount(row, minlength=part.rows)),
                        pa.array(known), pa.array(base), pa.array(score), rare, pa.array(base_row + np.arange(part.rows)),
                    ], ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "row"])
                    fields, base_row = list(texts.schema), base_row + part.rows
                    none = [pa.nulls(part.rows, t) for t in (pa.int32(), *[pa.binary()] * 4)]
                    yield pa.RecordBatch.from_arrays([*texts.columns, *none], [*texts.schema.names, *_ASKED])
                    if size > _COMPACT // 2:
                        yield from out()
                        size = 0
            yield from out()

        id_type = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<k:long,n:int,u:long,h:long>>, row long, {_ASKED_TYPES}"
        slim = docs.select("doc_id", "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.calls += 1
        parts = []
        for at in range(SCORE_SLICES):
            part = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(SCORE_SLICES)) == at).mapInArrow(run, schema)
            parts.append(self._rest(part, f"{self.calls}-{at}"))
            self._release()
        shared.destroy()
        return reduce(DataFrame.unionByName, parts).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

    def close(self) -> None:
        """Drop the stored words and dishes; scores made before stay."""
        for name in ("dishes", f"state-{SWEEPS}"):
            self.scratch.drop(name)

    def _rest(self, part: DataFrame, name: str) -> DataFrame:
        """A slice of the scores with what the heads don't know, stored.

        What a word has from the root is in the score before its dish is looked up; a dish adds the log of 1 + mass * per.
        """
        first = self.scratch.save(part, f"heads-{name}")
        near, first = first.where("b is not null").select(*_ASKED), first.where("b is null")
        (cp, tp), (cn, tn) = self.totals
        d0, d1, types, total = self.d0, self.d1, self.types, self.total
        roots = [_root_column("seated_p", "tables_p", (cp, tp), types, d0), _root_column("seated", "tables", (cn, tn), types, d0)]
        of_word = self.state.select("h", "c", "seated", "tables", "seated_p", "tables_p")
        of_context = self.state.select(F.col("h").alias("u"), F.col("c").alias("of"), *((F.lit(STRENGTH) + F.lit(d1) * F.col(n)).alias(f"back_{n}") for n in ("of_p", "of")))
        rest = first.select("row", F.explode("rare").alias("x")).select("row", "x.k", "x.n", "x.u", "x.h")
        rest = rest.join(of_word.hint("shuffle_hash"), "h", "left").join(of_context.hint("shuffle_hash"), "u", "left")
        backs = [F.coalesce(F.col(f"back_{n}") / (F.lit(STRENGTH) + F.col("of")), F.lit(1.0)) for n in ("of_p", "of")]
        rest = rest.withColumn("a", (backs[0] * roots[0] + backs[1] * roots[1]) / 2)
        c = F.coalesce("c", F.lit(0))
        # Words of the head had their base score in the task. A word or context never seen has no dish.
        unmet = c < self.least
        base = F.when(unmet, F.log10((c + 0.5) / (total + 0.5 * (types + 1)))).otherwise(0.0)
        rest = self.scratch.save(rest.select(
            "row", "k", "n", F.when((c > 0) & (F.col("of") > 0), 1 / ((F.col("of") + STRENGTH) * F.col("a"))).cast("float").alias("per"),
            F.when(unmet & (c > 0), F.col("n")).otherwise(0).alias("more"), (F.col("n") * base).alias("base2"), (F.col("n") * F.log10("a")).alias("score3"),
        ), f"rare-{name}")
        asked = near.unionByName(rest.where("per is not null").select("row", "k", "n", "per").mapInArrow(_asking(self.buckets), _ASKED_TYPES))
        found = asked.groupBy("b").cogroup(self.masses.groupBy("b")).applyInArrow(_look_up, "part long, at binary, s binary")
        sums = found.groupBy("part").applyInArrow(_sums, "row long, score2 double")
        bases = rest.groupBy("row").agg(F.sum("more").alias("more"), F.sum("base2").alias("base2"), F.sum("score3").alias("score3"))
        out = first.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(sums, "row", "left").join(bases, "row", "left")
        out = out.select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("score2", F.lit(0.0)) + F.coalesce("score3", F.lit(0.0))).alias("score"),
        )
        with _hashed_joins(self.scratch.spark):
            out = self.scratch.save(out, f"scored-{name}")
        for done in ("heads", "rare"):
            self.scratch.drop(f"{done}-{name}")
        return out


def perplexity(scored: DataFrame, *by: str) -> DataFrame:
    """Perplexity of all tokens of the rows of ``scored`` with the same ``by``; no row for no tokens."""
    sums = scored.groupBy(*by).agg(F.sum("score").alias("score"), F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    return sums.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
