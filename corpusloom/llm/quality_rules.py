"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

Of each text that the fixed rules keep, a vector of transformed statistics is taken. Per group (language and source, nulls
a group of their own) and per language a minimum covariance determinant estimate is fitted by concentration steps: each
keeps the share SUPPORT of the rows with the smallest distances and takes mean and covariance of these, which does not raise
the determinant. There are two starts, medians with median deviations, and the covariance of spatial signs; after START_STEPS
steps the one with the smaller determinant goes on until no log determinant moves by TOLERANCE, or MOST_STEPS are done. The
covariance is multiplied by the consistency factor of SUPPORT. All rows take part; the steps are grouped sums and quantile
sketches, so a hot group is summed where it lies, and nothing but one row of figures is sent to the driver.

A group of n rows counts with weight n / (n + SHRINK), its language with the rest; a language likewise against all
languages (their weighted mean, widened by their spread). So small groups follow their language without a size at which that
begins. An axis that is constant on most rows has no spread to estimate: there the tolerance LEAST_DEVIATION decides, which on
the other axes lies far below their spread and only keeps a matrix invertible. An axis counts as a degree of freedom by the
part of its variance that is its own, so a constant axis has none. Distances are divided by the median of a chi-square law
with so many degrees, and by the median of these quotients in their language where it is above 1. A text whose squared
distance exceeds the law's quantile at CUTOFF_DEVIATIONS is rejected.

An empty table stays empty; a null or empty text fails the fixed rules. Ties at the quantile are all kept. Other columns are
ignored, repeated rows count each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.phrase_index import bounded
from corpusloom.llm.scratch import Scratch
from corpusloom.llm.statistics import with_statistics

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SUPPORT = 0.75
START_STEPS = 2
MOST_STEPS = 10
TOLERANCE = 1e-3
#: An estimate of so many rows counts as much as the one it is shrunk to.
SHRINK = 50
#: Squared distances are held against the chi-square quantile at so many standard normal deviations.
CUTOFF_DEVIATIONS = 5.0
#: The least standard deviation along each axis of AXES. Symbols, repeats and digits are zero nearly always and need one; the
#: others spread by 0.01 to 0.05, so theirs is far below that.
LEAST_DEVIATION = (0.005, 0.12, 0.12, 0.12, 0.003, 0.06, 0.003)

AXES = ["word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punct"]


def vector() -> list[Column]:
    """Transformed statistics: a log for the skewed length, square roots for shares."""

    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_upper", "n_chars"), share("n_digits", "n_chars"), share("n_punct", "n_chars"),
    ]


def chi_square(deviations: float, p: float) -> float:
    """The quantile of a chi-square law at a standard normal deviate, by the cube-root approximation."""
    return p * (1 - 2 / (9 * p) + deviations * np.sqrt(2 / (9 * p))) ** 3


def consistency(support: float, p: int) -> float:
    """What the covariance of the nearest share of a normal law is multiplied by to have that of all of it."""

    def below(q: float, of: int) -> float:  # the chi-square distribution function, by its series
        half, term = of / 2, 1.0
        total, k = term, 0
        while term > 1e-12 * total:
            k += 1
            term *= q / 2 / (half + k)
            total += term
        return math.exp(half * math.log(q / 2) - q / 2 - math.lgamma(half + 1)) * total

    low, high = 1e-6, 100.0 * p
    for _ in range(100):
        low, high = ((low + high) / 2, high) if below((low + high) / 2, p) < support else (low, (low + high) / 2)
    return support / below(low, p + 2)


def _full(cross: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from the rows of their upper triangles."""
    out = np.zeros((len(cross), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = out[:, j, i] = cross
    return out


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _stacked(column: pd.Series, p: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, p))


def _distance(p: int) -> Column:
    """The squared distance of x from centre under inverse, an upper triangle whose other entries count twice."""
    off = [F.col(f"x{i}") - F.col("centre")[i] for i in range(p)]
    terms = [off[i] * off[j] * F.col("inverse")[k] for k, (i, j) in enumerate(_upper(p))]
    return sum(terms[1:], terms[0])


_STATE = "key string, start int, n long, centre array<double>, cov array<double>, inverse array<double>, logdet double"


def _states(p: int):
    """Per row (key, start, n, mean of offsets, mean of their products, centre): the estimate as a state."""
    doubled = np.array([1.0 if i == j else 2.0 for i, j in _upper(p)])
    least, triangle = np.diag(np.square(LEAST_DEVIATION[:p])), np.triu_indices(p)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            mean, cross, centre = (_stacked(pdf[c], p) for c in ("mean", "cross", "centre"))
            cov = _full(cross, p) - mean[:, :, None] * mean[:, None, :]
            inverse, logdet = np.linalg.inv(cov + least), np.linalg.slogdet(cov + least)[1]
            yield pd.DataFrame({
                "key": pdf["key"], "start": pdf["start"], "n": pdf["n"], "centre": list(centre + mean), "cov": list(cov[:, *triangle]),
                "inverse": list(inverse[:, *triangle] * doubled), "logdet": logdet,
            })

    return run


def _moments(off: list[Column], p: int) -> list[Column]:
    """Row count, means and mean products of offsets."""
    return [F.count("*").alias("n"), F.array(*(F.avg(o) for o in off)).alias("mean"), F.array(*(F.avg(off[i] * off[j]) for i, j in _upper(p))).alias("cross")]


def _starts(rows: DataFrame, scratch: Scratch, p: int) -> DataFrame:
    """The states of both starts of each key."""
    xs = [F.col(f"x{i}") for i in range(p)]
    medians = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.percentile_approx(x, 0.5) for x in xs)).alias("centre")), "medians")
    off = rows.join(bounded(medians), "key")
    # 1.4826 times the median deviation is the deviation of a normal law.
    mads = off.groupBy("key").agg(F.array(*(F.percentile_approx(F.abs(x - F.col("centre")[i]), 0.5) * 1.4826 for i, x in enumerate(xs))).alias("mad"))
    mads = scratch.save(medians.join(mads, "key"), "deviations")
    z = [(x - F.col("centre")[i]) / F.sqrt(F.col("mad")[i] * F.col("mad")[i] + LEAST_DEVIATION[i] ** 2) for i, x in enumerate(xs)]
    at = rows.join(bounded(mads), "key").select("key", "centre", "mad", *(c.alias(f"z{i}") for i, c in enumerate(z)))
    norm = F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")), F.lit(1e-12))
    signs = at.groupBy("key").agg(F.count("*").alias("n"), F.first("centre").alias("centre"), F.first("mad").alias("mad"), F.array(*(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / norm) for i, j in _upper(p))).alias("signs"))
    one = np.array([float(i == j) for i, j in _upper(p)])

    def both(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The size of a start's matrix plays no part, as a step only ranks distances.
        for pdf in parts:
            mad, shape = _stacked(pdf["mad"], p), _stacked(pdf["signs"], p)
            i, j = np.triu_indices(p)
            side = np.sqrt(np.square(mad) + np.square(LEAST_DEVIATION[:p]))
            for start, of in enumerate((one[None], p * shape)):
                yield pd.DataFrame({"key": pdf["key"], "start": start, "n": pdf["n"], "mean": list(np.zeros_like(mad)), "cross": list(of * side[:, i] * side[:, j]), "centre": pdf["centre"]})

    made = signs.mapInPandas(both, "key string, start int, n long, mean array<double>, cross array<double>, centre array<double>")
    return scratch.save(made.mapInPandas(_states(p), _STATE), "step-0")


def _step(rows: DataFrame, now: DataFrame, scratch: Scratch, name: str, p: int) -> DataFrame:
    """One concentration step of every state."""
    keys = ["key", "start"]
    slim = bounded(now.select(*keys, "centre", "inverse"))
    at = rows.join(slim, "key").select(*keys, "centre", *(f"x{i}" for i in range(p)), _distance(p).alias("d"))
    limit = scratch.save(at.groupBy(*keys).agg(F.percentile_approx("d", SUPPORT).alias("limit")), f"limits-{name}")
    near = at.join(bounded(limit), keys).where("d <= limit")
    sums = near.groupBy(*keys).agg(*_moments([F.col(f"x{i}") - F.col("centre")[i] for i in range(p)], p), F.first("centre").alias("centre"))
    return scratch.save(sums.mapInPandas(_states(p), _STATE), f"step-{name}")


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, n, centre, cov, steps)`` per key of ``rows(key, x)``: the estimate before LEAST_DEVIATION, with all rows counted in n."""
    p = len(AXES)
    rows = scratch.save(rows.select("key", *(F.col("x")[i].alias(f"x{i}") for i in range(p))), "vectors")
    now = _starts(rows, scratch, p)
    sizes = scratch.spark.read.parquet(f"{scratch.root}/medians").select("key", "n")
    for step in range(1, START_STEPS + 1):
        now = _step(rows, now, scratch, str(step), p)
    best = F.min_by(F.struct("start", "centre", "inverse", "cov", "logdet"), F.struct("logdet", "start")).alias("b")
    now = scratch.save(now.groupBy("key").agg(best).select("key", "b.*"), "best")
    while step < MOST_STEPS:
        step, last = step + 1, now
        now = _step(rows, now, scratch, str(step), p)
        moved = now.join(last.select("key", F.col("logdet").alias("was")), "key").agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if (moved or 0.0) < TOLERANCE:
            break
    factor = consistency(SUPPORT, p)
    out = now.join(sizes.withColumnRenamed("n", "all"), "key").select("key", F.col("all").alias("n"), "centre", F.transform("cov", lambda v: v * factor).alias("cov"), F.lit(step).alias("steps"))
    return scratch.save(out, "estimates")


def shrunk(fitted: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, centre, inverse, middle, limit)`` per row of ``groups(key, lang)``, both of which are keys of ``fitted``.

    middle and limit are the median and the cutoff of a chi-square law of the estimate's degrees of freedom, 1 at least.
    """
    p = len(AXES)
    cells, triangle = _upper(p), np.triu_indices(p)
    least, doubled = np.diag(np.square(LEAST_DEVIATION[:p])), np.array([1.0 if i == j else 2.0 for i, j in cells])
    langs = fitted.join(groups.select(F.col("lang").alias("key")).distinct(), "key")

    def mean(c: Column) -> Column:
        return F.sum(F.col("n") * c) / F.sum("n")

    # The mean of all languages' second moments about zero, less the square of their mean: covariances and spread together.
    total = langs.agg(F.array(*(mean(F.col("centre")[i]) for i in range(p))), F.array(*(mean(F.col("cov")[k] + F.col("centre")[i] * F.col("centre")[j]) for k, (i, j) in enumerate(cells)))).first()
    all_centre = np.array([v or 0.0 for v in total[0]])
    all_cov = _full(np.array([[v or 0.0 for v in total[1]]]), p)[0] - np.outer(all_centre, all_centre)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            centre, cov = np.broadcast_to(all_centre, (len(pdf), p)), np.broadcast_to(all_cov, (len(pdf), p, p))
            for at in ("lang_", ""):
                w = pdf[f"{at}n"].to_numpy(np.float64)
                w = (w / (w + SHRINK))[:, None]
                centre = w * _stacked(pdf[f"{at}centre"], p) + (1 - w) * centre
                cov = w[:, :, None] * _full(_stacked(pdf[f"{at}cov"], len(cells)), p) + (1 - w)[:, :, None] * cov
            inverse = np.linalg.inv(cov + least)[:, *triangle] * doubled
            own = np.diagonal(cov, axis1=1, axis2=2)
            degrees = np.maximum((own / (own + np.diag(least))).sum(1), 1.0)
            yield pd.DataFrame({"key": pdf["key"], "centre": list(centre), "inverse": list(inverse), "middle": chi_square(0.0, degrees), "limit": chi_square(CUTOFF_DEVIATIONS, degrees)})

    of_lang = langs.select(F.col("key").alias("lang"), *(F.col(c).alias(f"lang_{c}") for c in ("n", "centre", "cov")))
    both = groups.join(fitted, "key").join(of_lang, "lang").select("key", "n", "centre", "cov", "lang_n", "lang_centre", "lang_cov")
    return scratch.save(both.mapInPandas(run, "key string, centre array<double>, inverse array<double>, middle double, limit double"), "shrunk")


def judge(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)`` per row."""
    scratch, p = Scratch(docs.sparkSession), len(AXES)
    slim = docs.select("doc_id", F.to_json(F.struct("lang", "source")).alias("key"), F.concat(F.lit("lang "), F.to_json(F.struct("lang"))).alias("lang"), F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = scratch.save(with_statistics(slim).select(*base, "key", "lang", failed.alias("base_failed"), F.array(*vector()).alias("x")), "rows")
    good = rows.where("not base_failed")
    groups = scratch.save(good.select("key", "lang").distinct(), "groups")
    # A row takes part in the estimate of its group and in that of its language.
    fitted = estimates(good.select(F.explode(F.array("key", "lang")).alias("key"), "x"), scratch)
    found = rows.join(bounded(shrunk(fitted, groups, scratch)), "key", "left")
    found = found.select(*base, "lang", "base_failed", "centre", "inverse", "middle", "limit", *(F.col("x")[i].alias(f"x{i}") for i in range(p)))
    found = found.select(*base, "lang", "base_failed", "middle", "limit", _distance(p).alias("raw"))
    found = scratch.save(found, "distances")
    wide = found.where("not base_failed").groupBy("lang").agg(F.percentile_approx(F.col("raw") / F.col("middle"), 0.5).alias("wide"), F.count("*").alias("n"))
    # Never below 1: narrowing could reject clean rows.
    scale = F.greatest(F.lit(1.0), (F.col("n") * F.col("wide") + SHRINK) / (F.col("n") + SHRINK))
    found = found.join(bounded(scratch.save(wide.select("lang", scale.alias("scale")), "scales")), "lang", "left")
    distance = F.col("raw") / F.col("scale")
    kept = ~F.col("base_failed") & F.coalesce(distance <= F.col("limit"), F.lit(False))
    return found.select(*base, "base_failed", kept.alias("kept"), distance.alias("distance"))
