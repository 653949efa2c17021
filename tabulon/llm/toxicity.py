"""Toxicity by a weighted finite-state grammar over clauses.

Words have classes: insults (learned from labels, whole words and beginnings of
words), verbs of harm, words for persons, negations, verbs of saying, quotation
marks. Five small transducers read the classes of a clause, each with states and
arcs of its own, and put marks on what they read:

* *insult* marks insults, and a person soon after one as aimed at;
* *threat* is open after a verb of harm and marks the person it meets;
* *target* is open after a person and marks what is near;
* *negation* is open after a negating word and marks what it governs;
* *reported speech* is open from a verb of saying to the clause's end, or
  between quotation marks, and marks what is told.

They are composed into one machine, whose states are tuples of theirs. Its path
through a clause has a weight: for each matched insult or threat its own weight
times a factor for each other mark on it. The factors are learned from labels.
A logistic curve over the path weights of a text's clauses gives its score.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bounded, as_text, pick

# Closed word classes of English, German, French and Spanish.
NEGATIONS = """not no never none nor without isn't aren't wasn't weren't don't doesn't
nicht kein keine nie niemals ohne ne pas jamais sans no nunca sin""".split()
REPORTING = """said says say wrote writes claimed claims reported reports quoted called
sagte sagt schrieb behauptete dit disait écrit affirme dijo dice escribió""".split()
TARGETS = """you your he him she her they them we us people man woman men women
du dich ihr euch sie er ihn tu toi vous il elle ils elles usted ustedes él ella ellos""".split()
HARMS = """kill hurt destroy beat shoot stab burn murder attack hang
töten schlagen erschießen verbrennen tuer frapper brûler matar golpear quemar""".split()
#: Classes of words: insult, harm, person, negation, saying, quotation mark, other.
CLASSES = "ihtnrq-"
#: Beginnings of words that may become insult arcs, in letters; distance in words that marks reach.
STEMS, REACH = range(4, 9), 3
#: Before any label: factors of marks, and what a threat or an aim weighs by itself.
PRIOR = {"targeted": 1.25, "negated": 0.4, "reported": 0.6, "threat": 3.0, "aimed": 0.5}
#: What an insult's weight has to exceed, for whole words and for beginnings; deviations below the odds.
LEAST, LEAST_STEM, SURE = 1.5, 2.5, 2.0

CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")
QUOTES = frozenset("\"“”«»")

Marks = frozenset[str]


@dataclass(frozen=True)
class Machine:
    """A transducer: (state, class) -> (next state, mark or none); 0 is its first state."""

    arcs: dict[tuple[int, str], tuple[int, str | None]]


def window(opens: str, mark: Callable[[int, str], str | None], closes: bool = False) -> Machine:
    """Open for REACH words after a class of ``opens``: the state counts what is left.

    ``mark(state, class)`` is put on what is read; with ``closes`` a mark ends it.
    """
    arcs = {}
    for k, c in itertools.product(range(REACH + 1), CLASSES):
        put = mark(k, c)
        arcs[k, c] = (REACH if c in opens else 0 if closes and put else max(0, k - 1)), put
    return Machine(arcs)


def machines() -> dict[str, Machine]:
    """The five transducers by name."""
    # Reported: 0 plain, 1 after a verb of saying, 2 between quotation marks.
    told = {(s, c): (s, "reported" if s else None) for s in range(3) for c in CLASSES}
    told |= {(0, "r"): (1, None), (0, "q"): (2, None), (2, "q"): (0, None)}
    return {
        "insult": window("i", lambda k, c: "insult" if c == "i" else "aimed" if c == "t" and k else None, closes=True),
        "threat": window("h", lambda k, c: "threat" if c == "t" and k else None, closes=True),
        "target": window("t", lambda k, c: "targeted" if k and c != "t" else None),
        "negation": window("n", lambda k, c: "negated" if k else None),
        "reported": Machine(told),
    }


@dataclass(frozen=True)
class Composed:
    """The product of machines: by state and class, the next state and the set of marks."""

    step: list[dict[str, tuple[int, int]]]
    marks: list[Marks]


def compose(parts: list[Machine]) -> Composed:
    """All states that are reached from the first, as tuples of the parts' states."""
    number, step, marks = {(0,) * len(parts): 0}, [], [frozenset()]
    todo = list(number)
    for state in todo:  # grows while it is read
        row = {}
        for c in CLASSES:
            moves = [m.arcs[s, c] for m, s in zip(parts, state, strict=True)]
            after, put = tuple(m[0] for m in moves), frozenset(m[1] for m in moves if m[1])
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            if put not in marks:
                marks.append(put)
            row[c] = number[after], marks.index(put)
        step.append(row)
    return Composed(step, marks)


def values(marks: list[Marks], weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """For each set of marks, what an insult's weight is multiplied by and what is added."""
    times, plus = np.zeros(len(marks)), np.zeros(len(marks))
    for i, put in enumerate(marks):
        factor = math.prod(weights[m] for m in put & {"targeted", "negated", "reported"})
        times[i] = factor * ("insult" in put)
        plus[i] = factor * sum(weights[m] for m in put & {"threat", "aimed"})
    return times, plus


Clause = dict[int, tuple[float, int]]


@dataclass
class Grammar:
    """Weights of insult arcs and of marks, and the curve over the clauses' path weights."""

    arcs: dict[str, float]
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.0, 0.5, 0.0, 0.0])
    without: tuple[str, ...] = ()

    def __post_init__(self):
        self.machine = compose([m for name, m in machines().items() if name not in self.without])
        self.set_weights(self.weights)

    def set_weights(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.times, self.plus = values(self.machine.marks, weights)

    def words(self) -> Bounded:
        """Each word's class and weight: a closed class, a whole-word arc or a beginning."""
        closed = [(HARMS, "h"), (REPORTING, "r"), (TARGETS, "t"), (NEGATIONS, "n"), (QUOTES, "q")]
        kinds = {w: k for words, k in closed for w in words}
        arcs = self.arcs

        def look(word: str) -> tuple[str, float]:
            if word in kinds:
                return kinds[word], 0.0
            if word in arcs:
                return "i", arcs[word]
            weight = max((arcs.get(word[:n] + "*", 0.0) for n in STEMS if n < len(word)), default=0.0)
            return ("i", weight) if weight else ("-", 0.0)

        return Bounded(look, 100_000)

    def clause(self, read: list[tuple[str, float]]) -> Clause:
        """The marks that matter on the path through a clause: weight of insults, and number, by set."""
        state, step, out = 0, self.machine.step, {}
        for c, weight in read:
            state, put = step[state][c]
            if put:
                w, n = out.get(put, (0.0, 0))
                out[put] = w + weight, n + 1
        return out

    def clauses(self, text: str, words: Bounded) -> tuple[list[Clause], int]:
        """The clauses of a whole text that hold an insult or a threat, and the number of its words."""
        out, size = [], 0
        for part in CLAUSE.split(text.lower()):
            tokens = TOKEN.findall(part)
            size += len(tokens)
            read = [words[t] for t in tokens]
            if any(c in "ih" for c, _ in read):
                out.append(self.clause(read))
        return out, size

    def features(self, each: list[Clause], size: int) -> tuple[float, float, float, float]:
        """Greatest and summed path weight, matched clauses, and their density."""
        sums = [sum(w * self.times[i] + n * self.plus[i] for i, (w, n) in c.items()) for c in each]
        sums = [x for x in sums if x > 0]
        return max(sums, default=0.0), math.log1p(sum(sums)), math.log1p(len(sums)), 100 * len(sums) / (size + 50)

    def score(self, texts: list[str], words: Bounded) -> np.ndarray:
        x = np.array([self.features(*self.clauses(t, words)) for t in texts]).reshape(-1, 4)
        z = self.curve[0] + x @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> list[float]:
    """Logistic weights by Newton's method with a small ridge; bias first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * len(x) * np.eye(len(w))
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step * min(1, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows that ``train`` admits.

    The rows with the least hashes of their ids are taken, so the choice doesn't
    depend on order. ``most`` also bounds what the join broadcasts.
    """
    ids = pick(labels, "doc_id", label).toDF("id", "y").filter("id is not null and y in (0, 1)").filter(train)
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    docs = pick(docs, "doc_id", "text")
    return docs.join(F.broadcast(ids), docs["doc_id"] == ids["id"]).select("doc_id", "text", "y")


def loss(x: np.ndarray, y: np.ndarray, curve: list[float]) -> float:
    z = np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30)
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_weights(grammar: Grammar, each: list[tuple[list[Clause], int]], y: np.ndarray, rounds: int = 2, keep: float = 2e-3) -> None:
    """Set the marks' weights and the curve to what the labelled texts are likeliest under.

    ``each`` has the clauses of a text that hold marks, and its size.

    One weight after the other is moved by steps; moving away from the prior
    costs ``keep`` for each unit of the logarithm squared, so that a mark which
    the texts say nothing about stays where it was.
    """

    flat = [(t, i, w, n) for t, (clauses, _) in enumerate(each) for c in clauses for i, (w, n) in c.items()]
    of_clause = [k for k, c in enumerate(c for clauses, _ in each for c in clauses) for _ in c]
    text, mark_of, w, n = (np.array(x) for x in zip(*flat, strict=True)) if flat else (np.empty(0, int),) * 4
    clause_text = np.array([t for t, (clauses, _) in enumerate(each) for _ in clauses], int)
    size = np.array([size for _, size in each])

    def tried(weights: dict[str, float]) -> tuple[float, list[float]]:
        times, plus = values(grammar.machine.marks, weights)
        sums = np.bincount(of_clause, w * times[mark_of] + n * plus[mark_of], len(clause_text)) if flat else np.zeros(len(clause_text))
        greatest, total = np.zeros(len(each)), np.bincount(clause_text, sums, len(each))
        np.maximum.at(greatest, clause_text, sums)
        matched = np.bincount(clause_text, sums > 0, len(each))
        x = np.column_stack([greatest, np.log1p(total), np.log1p(matched), 100 * matched / (size + 50)])
        curve = fit_curve(x, y)
        return loss(x, y, curve) + keep * sum(math.log(weights[m] / PRIOR[m]) ** 2 for m in PRIOR), curve

    best = dict(PRIOR)
    least, curve = tried(best)
    met = set().union(*(grammar.machine.marks[i] for i in set(mark_of.tolist())))
    for _ in range(rounds):
        for mark in sorted(met & set(PRIOR)):
            for step in (4.0, 2.0, 1.4, 1 / 1.4, 1 / 2, 1 / 4):
                new = best | {mark: best[mark] * step}
                found = tried(new)
                if found[0] < least - 1e-9:
                    best, (least, curve) = new, found
    grammar.set_weights(best)
    grammar.curve = curve


def odds(a: Column | float, b: Column | float, na: float, nb: float, log: Callable, root: Callable):
    """Low end of the log odds of a word in toxic and in other texts, from its counts."""
    return log((a + 0.5) / (na + 1)) - log((b + 0.5) / (nb + 1)) - SURE * root(1 / (a + 0.5) + 1 / (b + 0.5))


def lexicon(rows: list, na: float, nb: float, out_a: int = 0, out_b: int = 0) -> dict[str, float]:
    """Insult arcs from (word, a, b), leaving out so many texts that hold the word."""
    found = {}
    for word, a, b in rows:
        a, b = a - out_a, max(0, b - out_b)
        if a >= max(2, round(0.005 * na)):
            w = odds(a, b, na - out_a, nb - out_b, math.log, math.sqrt)
            if w > (LEAST_STEM if word.endswith("*") else LEAST):
                found[word] = w
    return found


def learn(docs: DataFrame, labels: DataFrame, train: Column, most: int = 12_000, without: tuple[str, ...] = ()) -> Grammar | None:
    """A grammar from at most ``most`` labelled texts.

    An insult's weight is the low end of the log odds of its being met in toxic
    and in other texts. A text counts once for its family, the least hash of its
    three-word passages, so that a thousand copies of one text count as one. The
    marks' weights and the curve are fitted to the same texts, each read with
    the insults as they would be without it. ``train`` is a condition on the
    column ``id``; ``without`` names machines to leave out. Without rows of both
    labels there is nothing to learn: None.
    """
    import xxhash

    sample = labelled_sample(docs, labels, "toxic", train, most).cache()

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, y in zip(as_text(pdf["text"]), pdf["y"], strict=True):
                tokens = TOKEN.findall(text.lower())
                runs = {" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))}
                family = min(xxhash.xxh3_64_intdigest(r) >> 1 for r in runs)
                found = set(tokens) - QUOTES
                found |= {t[:n] + "*" for t in found for n in STEMS if n < len(t)}
                out += [(w, int(y), family) for w in found] + [("", int(y), family)]
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=["word", "y", "family"])
                    out = []
            yield pd.DataFrame(out, columns=["word", "y", "family"])

    met = sample.mapInPandas(seen, "word string, y int, family long").distinct()
    counts = met.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    totals = counts.filter("word = ''").first()
    if totals is None or not totals["a"] or not totals["b"]:
        sample.unpersist()
        return None
    na, nb = totals["a"], totals["b"]
    fewer = F.greatest(F.col("b") - 1, F.lit(0))
    good = (F.col("a") >= max(2, round(0.005 * na))) & (odds(F.col("a"), fewer, na, nb, F.log, F.sqrt) > LEAST)
    rows = [tuple(r) for r in counts.filter("word <> ''").filter(good).select("word", "a", "b").collect()]  # few of the sample's words
    grammar = Grammar(lexicon(rows, na, nb), without=without)
    left = [Grammar(lexicon(rows, na, nb, y, 1 - y), without=without) for y in (0, 1)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = [g.words() for g in left]
        for pdf in batches:
            out = []
            for doc_id, text, y in zip(pdf["doc_id"], as_text(pdf["text"]), pdf["y"], strict=True):
                each, size = left[y].clauses(text, words[y])
                flat = [(k, i, w, n) for k, c in enumerate(each) for i, (w, n) in c.items()]
                out.append((doc_id, y, size, *(zip(*flat, strict=True) if flat else ((), (), (), ()))))
            yield pd.DataFrame(out, columns=["doc_id", "y", "size", "k", "i", "w", "n"])

    got = sample.mapInPandas(read, "doc_id long, y int, size long, k array<int>, i array<int>, w array<double>, n array<int>").collect()
    sample.unpersist()
    each = []
    for r in sorted(got, key=str):  # rows come in any order
        clauses: dict[int, Clause] = {}
        for k, i, w, n in zip(r["k"], r["i"], r["w"], r["n"], strict=True):
            clauses.setdefault(k, {})[i] = (w, n)
        each.append((list(clauses.values()), r["size"]))
    fit_weights(grammar, each, np.array([float(r["y"]) for r in sorted(got, key=str)]))
    return grammar


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, most: int = 12_000) -> DataFrame:
    """(doc_id, score): how likely each whole text of ``docs`` is toxic.

    Null and empty texts have no clause and get the curve's lowest score. Where
    the labels admitted by ``train`` lack a class, every score is 0. Repeated
    rows give repeated rows, of one score; an empty table gives none. Columns
    other than doc_id and text, whatever their names, are not read.
    """
    grammar = learn(docs, labels, train, most)
    docs = pick(docs, "doc_id", "text")
    if grammar is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    return docs.select("doc_id", scorer(grammar)("text").alias("score"))


def scorer(grammar: Grammar) -> Callable[[str], Column]:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = grammar.words()
        for texts in batches:
            yield pd.Series(grammar.score(as_text(texts), words))

    return scored


def reject_toxic(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.5, most: int = 12_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.

    Rows go by their texts alone: null ids and repeated rows stay or go alike.
    """
    grammar = learn(docs, labels, train, most)
    if grammar is None:
        return docs
    names = docs.columns
    own = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    return own.filter(scorer(grammar)(f"_c{names.index('text')}") < threshold).toDF(*names)
