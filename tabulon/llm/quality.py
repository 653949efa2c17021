"""Quality by a sparse ensemble of rules over statistics of a text.

Shallow regression trees are grown on the statistics of a bounded sample of
labelled texts, each on a random part of the rows and columns. Every path from a
root becomes a rule, a conjunction of thresholds. A logistic regression with a
lasso penalty keeps few rules, and those are compiled into one column expression
over the statistics, so that scoring needs no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .toxicity import labelled_sample


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, by name; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.split(t, r"[\x20\x09-\x0D]+")
    lines = F.split(t, "\n")
    per = lambda x: x / (chars + F.lit(1.0))
    count = lambda s: chars - F.length(F.replace(t, F.lit(s)))
    return {
        "chars": F.log1p(chars.cast("double")),
        "mean_word": chars / F.size(words).cast("double"),
        "new_words": F.size(F.array_distinct(words)) / F.size(words).cast("double"),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_length": F.log1p(chars / F.size(lines).cast("double")),
        "upper": per(F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double")),
        "digits": per(F.regexp_count(t, F.lit("[0-9]")).cast("double")),
        "bars": per(count("|").cast("double")),
        "bangs": per(count("!").cast("double")),
        "stops": per(count(".").cast("double")),
        "commas": per(count(",").cast("double")),
        "marks": per(F.regexp_count(t, F.lit("[#$%&*@<>{}=_~^/\\\\]")).cast("double")),
    }


Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class Rules:
    """bias + the weights of the rules that hold, through a logistic curve."""

    bias: float
    weights: list[tuple[Rule, float]]

    def column(self, at: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            held = F.lit(True)
            for name, above, cut in rule:
                held = held & ((at[name] > F.lit(cut)) if above else (at[name] <= F.lit(cut)))
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, columns: np.ndarray, depth: int, least: int) -> list:
    """Paths of a regression tree as lists of (column, above, cut)."""
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return []
    found = None
    for c in columns:
        cuts = np.unique(np.quantile(x[:, c], np.linspace(0.02, 0.98, 25)))
        for cut in cuts:
            low = x[:, c] <= cut
            n = low.sum()
            if least <= n <= len(y) - least:
                gain = n * y[low].mean() ** 2 + (len(y) - n) * y[~low].mean() ** 2
                if found is None or gain > found[0]:
                    found = gain, c, cut, low
    if found is None:
        return []
    _, c, cut, low = found
    out = []
    for above, rows in ((False, low), (True, ~low)):
        step = (int(c), above, float(cut))
        out += [[step], *([step, *p] for p in grow(x[rows], y[rows], columns, depth - 1, least))]
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    x1 = np.column_stack([np.ones(n), x])
    step = 4 * n / (np.linalg.norm(x1, 2) ** 2 + 1e-12)
    w = v = np.zeros(x1.shape[1])
    w[0] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -30, 30)))
        u = v - step * (x1.T @ (p - y)) / n
        new = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        new[0] = u[0]
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (last - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 4e-4, seed: int = 5) -> Rules:
    """Grow trees, turn their paths into rules, and keep those with weight."""
    rng, paths = np.random.default_rng(seed), set()
    least = max(3, len(y) // 400)
    residual = y - y.mean()
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), max(200, len(y) // 4)), replace=False)
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        for p in grow(x[rows], residual[rows], columns, depth, min(least, max(3, len(rows) // 50))):
            paths.add(tuple(sorted(p)))
    paths = sorted(paths)
    held = np.ones((len(y), len(paths)))
    for j, path in enumerate(paths):
        for c, above, cut in path:
            held[:, j] *= (x[:, c] > cut) if above else (x[:, c] <= cut)
    _, first = np.unique(held, axis=1, return_index=True)  # rules that never differ count once
    paths, held = [paths[i] for i in sorted(first)], held[:, sorted(first)]
    bias, w = lasso(held, y, penalty)
    rules = [(tuple((names[c], above, cut) for c, above, cut in p), float(v)) for p, v in zip(paths, w, strict=True) if abs(v) > 1e-4]
    return Rules(bias, rules)


def learn(docs: DataFrame, labels: DataFrame, train: Column, most: int = 12_000) -> Rules | None:
    """Rules from at most ``most`` labelled texts; None if a class is missing."""
    sample = labelled_sample(docs, labels, "quality", train, most)
    stats = statistics(F.col("text"))
    got = sample.select(F.col("y").cast("double").alias("y"), F.array(*stats.values()).alias("x")).collect()
    y, x = np.array([r["y"] for r in got]), np.array([r["x"] for r in got])
    if not len(y) or np.ptp(y) == 0:
        return None
    order = np.lexsort((*x.T, y))  # rows come in any order
    return fit_rules(list(stats), x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, most: int = 12_000) -> DataFrame:
    """(doc_id, score): how likely each whole text of ``docs`` is of quality.

    Null and empty texts are scored by their statistics like any other. Where
    the labels admitted by ``train`` lack a class, every score is 0.5. Repeated
    rows give repeated rows.
    """
    rules = learn(docs, labels, train, most)
    docs = pick(docs, "doc_id", "text")
    if rules is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    stats = statistics(F.col("text"))
    # The array keeps the statistics from being worked out anew for each rule.
    at = docs.select("doc_id", F.explode(F.array(F.struct(*(c.alias(n) for n, c in stats.items())))).alias("s"))
    return at.select("doc_id", rules.column({n: F.col(f"s.{n}") for n in stats}).alias("score"))
