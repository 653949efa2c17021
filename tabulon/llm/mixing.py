"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates that meet it,
those of least relative entropy to one copy each are exponentially tilted:
rate = min(3, exp(lambda * size / mean size)), with one lambda a source, the
solution of a convex dual. Newton iterations find all lambdas at once from
aggregates over (source, size). Rates become whole copies by a hash of the
document, with a cut per source that brings the sum to the target.

The main path has DataFrame functions only.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_words, pick, spool

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
#: No target and no document is beyond this many times its size.
MOST = 3
#: Documents at a source's cut that are weighed one by one; bins of a round.
AT_CUT, BINS = 256, 16
#: Up to so many sources, their parameters are broadcast.
FEW_SOURCES = 10_000


def targets(sizes: dict, weights: tuple = WEIGHTS, most: float = MOST) -> dict:
    """Target words of each source, from its size.

    Sources by code point, null last, share the sum of all sizes by weight; a
    target stops at ``most`` times its size and the excess is shared anew.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@dataclass
class Plan:
    """What each source needs: totals, target, tilt, mean size and cut."""

    spark: SparkSession
    sources: dict
    #: (source, key, copies) that documents at the cut get besides.
    chosen: list

    def small(self, rows: list[dict], schema: str) -> DataFrame:
        """A DataFrame of few rows, made in the JVM."""
        text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
        return self.spark.range(1).select(F.inline(text))

    def join(self, left: DataFrame, right: DataFrame, on: Column, how: str) -> DataFrame:
        few = len(self.sources) <= FEW_SOURCES
        return left.join(F.broadcast(right) if few else right, on, how)

    def parameters(self) -> DataFrame:
        rows = [{"p_source": s, **v} for s, v in self.sources.items()]
        return self.small(rows, "p_source string, source_size bigint, target double, tilt double, mean double, cut double")


def rate(size: Column) -> Column:
    """A document's rate under its source's tilt."""
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(50.0), F.col("tilt") * size / F.col("mean"))))


def margin(size: Column, key: Column) -> Column:
    """How far the fraction of a rate is above the document's draw in [0, 1)."""
    draw = F.pmod(key, F.lit(1 << 50)).cast("double") / F.lit(float(1 << 50))
    whole = F.floor(rate(size))
    return F.when(whole < MOST, rate(size) - whole - draw)


def document_key(doc_id: Column, text: Column) -> Column:
    """Alike for repeated rows only."""
    return F.xxhash64(doc_id, F.xxhash64(text), F.lit(4))


def solve(spark: SparkSession, sized: DataFrame, rounds: int = 60, close: float = 1e-9) -> Plan:
    """Targets, tilts and cuts from (source, size, key), a written table."""
    points = spool(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sums = points.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).collect()
    sizes = {r["source"]: int(r["words"]) for r in sums}
    goal = targets(sizes)
    plan = Plan(spark, {}, [])
    for r in sums:
        s = r["source"]
        mean = max(1.0, sizes[s] / r["docs"])
        plan.sources[s] = {"source_size": sizes[s], "target": goal[s], "tilt": 0.0, "mean": mean, "cut": 0.0}

    # Newton's method on the dual, kept within what is known to be too low and too high.
    low, high = dict.fromkeys(sizes, -math.inf), dict.fromkeys(sizes, math.inf)
    open_ = {s for s in sizes if sizes[s] and abs(goal[s] - sizes[s]) > close * goal[s]}
    for s in [s for s in open_ if goal[s] >= MOST * sizes[s] * (1 - 1e-12)]:
        plan.sources[s]["tilt"] = 50.0 * plan.sources[s]["mean"]  # all rates at the bound
        open_.discard(s)
    size, n = F.col("size"), F.col("n")
    for _ in range(rounds):
        if not open_:
            break
        at = plan.join(points.filter("size > 0"), plan.parameters(), F.col("source").eqNullSafe(F.col("p_source")), "inner")
        free = rate(size) < MOST
        got = at.groupBy("source").agg(
            F.sum(n * size * rate(size)).alias("f"), F.sum(F.when(free, n * size * size * rate(size) / F.col("mean")).otherwise(0.0)).alias("d")
        )
        for r in got.collect():
            s, f, d = r["source"], r["f"], r["d"]
            if s not in open_:
                continue
            x = plan.sources[s]["tilt"]
            low[s], high[s] = (x, high[s]) if f < goal[s] else (low[s], x)
            if abs(f - goal[s]) <= close * max(1.0, goal[s]) or high[s] - low[s] < 1e-12 * max(1.0, abs(x)):
                open_.discard(s)
                continue
            # In logarithms of the sum the steps are longer and as sure.
            step = f * math.log(goal[s] / f) / d if d > 0 and f > 0 and goal[s] > 0 else math.inf
            new = x + max(-8.0, min(8.0, step))
            if not low[s] < new < high[s]:
                a, b = low[s], high[s]
                new = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else (a + 8 if math.isfinite(a) else b - 8)
            plan.sources[s]["tilt"] = new
    find_cuts(plan, sized)
    return plan


def find_cuts(plan: Plan, sized: DataFrame, rounds: int = 14) -> None:
    """Set the cut of each source, and choose among the documents at it.

    The documents' margins are binned around the cut, ever more finely, until
    at most ``AT_CUT`` documents are in the bin that holds it; those are taken
    from the largest on while they fit.
    """
    at = plan.join(sized.filter("size > 0"), plan.parameters(), F.col("source").eqNullSafe(F.col("p_source")), "inner")
    size = F.col("size")
    margins = spool(
        at.select("source", "size", "key", F.floor(rate(size)).alias("whole"), margin(size, F.col("key")).alias("m")), "margins"
    )
    whole = {r["source"]: int(r["w"] or 0) for r in margins.groupBy("source").agg(F.sum(size * F.col("whole")).alias("w")).collect()}
    span = {s: (-1.0, 1.0 + 1e-9) for s in whole}
    above = dict.fromkeys(whole, 0)  # words of documents over the span
    open_ = set(whole)
    for _ in range(rounds):
        rows = [{"p_source": s, "a": span[s][0], "b": span[s][1]} for s in open_]
        if not rows:
            break
        got = plan.join(margins.filter("m is not null"), plan.small(rows, "p_source string, a double, b double"), F.col("source").eqNullSafe(F.col("p_source")), "inner")
        got = got.filter("m >= a and m < b")
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("m") - F.col("a")) / (F.col("b") - F.col("a")) * BINS)).cast("int")
        bins: dict = {}
        for r in got.groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect():
            bins.setdefault(r["source"], {})[r["bin"]] = (int(r["w"]), r["n"])
        for s in list(open_):
            a, b = span[s]
            room = plan.sources[s]["target"] - whole[s] - above[s]
            if sum(n for _, n in bins.get(s, {}).values()) <= AT_CUT:
                open_.discard(s)
                continue
            for i in range(BINS - 1, -1, -1):
                words = bins[s].get(i, (0, 0))[0]
                if words > room or i == 0:
                    edge = lambda j: a + (b - a) * j / BINS  # noqa: B023, E731
                    span[s] = edge(i), (edge(i + 1) if i + 1 < BINS else b)
                    break
                room -= words
                above[s] += words
    # Bins that no rounds make small hold repeated rows, which are decided together.
    rows = [{"p_source": s, "a": span[s][0], "b": span[s][1]} for s in whole]
    for s in whole:
        plan.sources[s]["cut"] = span[s][1]
    if not rows:
        return
    near = plan.join(margins.filter("m is not null"), plan.small(rows, "p_source string, a double, b double"), F.col("source").eqNullSafe(F.col("p_source")), "inner")
    near = near.filter("m >= a and m < b").groupBy("source", "key").agg(F.sum("size").alias("w"), F.max("whole").alias("f"))
    by: dict = {}
    for r in near.collect():
        by.setdefault(r["source"], []).append((int(r["w"]), r["key"], MOST - int(r["f"])))
    for s, docs in by.items():
        goal = plan.sources[s]["target"]
        more = fill(sorted(docs, reverse=True), goal - whole[s] - above[s], 0.001 * goal)
        plan.chosen += [(s, key, n) for key, n in more.items() if n]


def fill(docs: list[tuple[int, int, int]], room: float, close: float, tries: int = 16) -> dict[int, int]:
    """Copies to add of (words, key, most), largest documents first, to fill the room.

    One copy of each at first; where few documents leave more than ``close``
    open, further copies; and one more of the least if that is nearer. While the
    result isn't close, the same is tried without the first few documents.
    """
    found = None
    for skip in range(max(1, min(tries, len(docs)))):
        more, left = {key: 0 for _, key, _ in docs}, room
        for words, key, _ in docs[skip:]:
            more[key] = int(words <= left)
            left -= words * more[key]
        if left > close:
            for words, key, most in docs[skip:]:
                n = max(0, min(most - more[key], int(left // words)))
                more[key], left = more[key] + n, left - n * words
        open_ = [(words, key) for words, key, most in docs if more[key] < most]
        if open_ and abs(left - open_[-1][0]) < left:
            more[open_[-1][1]] += 1
            left -= open_[-1][0]
        if found is None or abs(left) < found[0]:
            found = abs(left), more
        if found[0] <= close:
            break
    return found[1]


def with_copies(df: DataFrame, plan: Plan) -> DataFrame:
    """``df``, which has source, size and key, with its source's numbers and ``copies``."""
    at = plan.join(df, plan.parameters(), F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    rows = [{"c_source": s, "c_key": k, "c_more": n} for s, k, n in plan.chosen]
    chosen = plan.small(rows, "c_source string, c_key bigint, c_more int")
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("key") == F.col("c_key"))
    at = plan.join(at, chosen, same, "left")
    size, m = F.col("size"), margin(F.col("size"), F.col("key"))
    more = F.coalesce("c_more", F.when(m >= F.col("cut"), 1).otherwise(0))
    copies = F.when(size > 0, F.least(F.lit(MOST), F.floor(rate(size)) + more)).otherwise(1).cast("long")
    return at.withColumn("copies", copies).drop("c_source", "c_key", "c_more", "tilt", "mean", "cut")


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key), written; the texts are read once."""
    docs = pick(docs, "doc_id", "text", "source")
    key = document_key(F.col("doc_id"), F.col("text"))
    return spool(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("key")), "sized")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document.

    A document without words costs nothing and has one copy. Repeated rows get
    the same number of copies. An empty table gives an empty result.
    """
    sized = sized_documents(docs)
    return with_copies(sized, solve(docs.sparkSession, sized)).drop("key")


def resample(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plan = solve(docs.sparkSession, sized_documents(docs))
    names = docs.columns
    kept = [f"_c{i}" for i in range(len(names))]
    own = docs.toDF(*kept)
    doc_id, text, source = (F.col(kept[names.index(n)]) for n in ("doc_id", "text", "source"))
    own = own.select(*kept, source.alias("source"), count_words(text).alias("size"), document_key(doc_id, text).alias("key"))
    out = with_copies(own, plan).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*kept).toDF(*names)
