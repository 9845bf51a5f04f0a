"""Quality classifier: conjunctive rules from boosted trees, weighted by a lasso logistic fit, run as column expressions.

Trees of depth DEPTH are boosted on the statistics of a sample of labelled rows; each path from a root is a rule. The rules
are 0/1 features of a logistic regression with an L1 penalty, which leaves few. These become Spark columns: the score of
every text is computed in the JVM from its statistics.

At most SAMPLE labelled rows train it, those with the least hash of their id: the one bounded sample here. Rows of one id with
several labels all count. With no labelled row the score is 0.5, with one class only that class's smoothed share. Null and
empty texts have zero statistics and a score like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.statistics import NAMES, with_statistics

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF = 30, 3, 32, 0.3, 10
PENALTY = 0.0005
ROUNDS = 400

#: Name and the expression of each feature, over the counts of a text.
FEATURES = {
    "log_words": "ln(1 + n_words)", "word_length": "word_chars / greatest(n_words, 1)", "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "upper": "n_upper / greatest(n_chars, 1)",
    "digits": "n_digits / greatest(n_chars, 1)", "punct": "n_punct / greatest(n_chars, 1)", "exclaim": "n_exclaim / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)", "short_words": "n_short_words / greatest(n_words, 1)", "long_words": "n_long_words / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)", "marks": "n_marks / greatest(n_words, 1)", "capitals": "n_capital_words / greatest(n_words, 1)", "line_words": "n_words / greatest(n_lines, 1)",
}

#: (feature, above, limit): feature > limit if above, else feature <= limit.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class Ensemble:
    """The fitted rules: logit = bias + sum of the weights of the rules that hold."""

    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score, between 0 and 1, as an expression over the columns of FEATURES."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            held = F.lit(True)
            for name, above, limit in rule:
                held = held & ((F.col(name) > limit) if above else (F.col(name) <= limit))
            total = total + F.when(held, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, step: np.ndarray) -> None:
    """Grow one tree on binned features; every node but the root adds its path to out, every leaf its step."""
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * LEAF:
        g, h = grad[rows].sum(), hess[rows].sum()
        for f in range(x.shape[1]):
            n = np.bincount(x[rows, f], minlength=BINS + 1)[:-1].cumsum()
            gl = np.bincount(x[rows, f], grad[rows], BINS + 1)[:-1].cumsum()
            hl = np.bincount(x[rows, f], hess[rows], BINS + 1)[:-1].cumsum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF) | (np.arange(BINS) >= len(cuts[f]))] = -1
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    _, f, b = best
    if f < 0:
        step[rows] = -grad[rows].sum() / (hess[rows].sum() + 1)
        return
    for above in (False, True):
        part = rows[(x[rows, f] > b) == above]
        longer = (*path, (f, above, float(cuts[f][b])))
        out.append(longer)
        _paths(x, cuts, grad, hess, part, depth - 1, longer, out, step)


def _tidy(path: tuple, names: list[str]) -> Rule:
    """One condition per feature and side."""
    held: dict[tuple[str, bool], float] = {}
    for f, above, limit in path:
        k = (names[f], above)
        held[k] = limit if k not in held else (max if above else min)(held[k], limit)
    return tuple(sorted((n, a, v) for (n, a), v in held.items()))


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, limit in rule:
        v = x[:, names.index(name)]
        out &= v > limit if above else v <= limit
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """Rules and weights from feature rows and 0/1 labels. The same rows in the same order give the same ensemble."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return Ensemble(float(np.log(share / (1 - share))), [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    logit, paths, step = np.full(len(y), np.log(share / (1 - share))), [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        _paths(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), paths, step)
        logit = logit + RATE * step
    rules, seen = [], set()
    for rule in dict.fromkeys(_tidy(p, names) for p in paths):
        held = _holds(rule, x, names)
        if held.tobytes() not in seen and 0 < held.sum() < len(held):
            seen.add(held.tobytes())
            rules.append((rule, held))
    m = np.stack([h for _, h in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    # Proximal gradient with momentum; the bias has no penalty.
    w, b, z, zb, t = np.zeros(m.shape[1]), np.log(share / (1 - share)), np.zeros(m.shape[1]), np.log(share / (1 - share)), 1.0
    v = np.ones(m.shape[1])
    for _ in range(20):
        v = m.T @ (m @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * (np.linalg.norm(m @ v) ** 2 / len(y) + 1) + 1e-12)
    for _ in range(ROUNDS):
        off = 1 / (1 + np.exp(-(m @ z + zb))) - y
        new = z - rate * (m.T @ off) / len(y)
        new, nb = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0), zb - rate * off.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return Ensemble(float(b), [(rule, float(k)) for (rule, _), k in zip(rules, w, strict=True) if k])


def features(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the columns of FEATURES. Columns that had these names, or those of statistics, are replaced."""
    counted = with_statistics(docs)
    keep = [c for c in docs.columns if c not in ("text", *FEATURES, *NAMES)]
    return counted.select(*keep, *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()))


def train(docs: DataFrame, labels: DataFrame) -> Ensemble:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, label)``; of more than SAMPLE labels those with the least id hash."""
    chosen = labels.select("doc_id", "label").where("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    names = list(FEATURES)
    rows = features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "label", *names).toArrow()
    x = np.stack([rows.column(n).to_numpy() for n in names], 1) if rows.num_rows else np.zeros((0, len(names)))
    return fit(x, rows.column("label").to_numpy().astype(np.float64), names)


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """The columns of ``docs`` but text, plus ``score``."""
    return features(docs).select(*(c for c in docs.columns if c != "text"), model.column().alias("score"))
