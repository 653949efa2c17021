"""Personal data: fixed forms, and forms found by bootstrapped contexts.

Base identifiers (e-mail, IP, card, phone) are found by their form. They seed a
graph of contexts and instances: a context is a pattern of the words around an
identifier-like string, or of a word's ending and the string's shape; an instance
is that string. Spark scores the graph in
rounds: a context is as good as the share of its instances that are known, an
instance as good as its contexts together. Contexts with high scores then mark
identifier-like strings that no base form covers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, pick, spool

#: In this order at equal starts.
KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every ip, card and phone lies within one run of the characters they use.
NUMBERS = re.compile(r"[0-9+][0-9 .()+\-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

#: Identifier-like strings that contexts may mark: around an at sign, or digits and few marks.
AROUND = re.compile(r"[^\s@,;:|<>\"'()\[\]]+")
LOOSE = re.compile(r"\+?[0-9](?:[ ().-]{0,2}[0-9])+")
WORD = re.compile(r"\S+")
#: Words and instances of more characters stand in contexts by a hash.
LONG = 64

#: Up to so many accepted contexts, every task holds them all.
FEW = 50_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping e-mails, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """All base identifiers of a text, by start and then by kind as listed."""
    out = list(emails(text)) if "@" in text else []
    for run in NUMBERS.finditer(text):
        s, at = run.group(), run.start()
        if len(s) < 7:
            continue
        for m in IP.finditer(s):
            if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", at + m.start(), at + m.end()))
        for m in CARD.finditer(s):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at + m.start(), at + m.end()))
        for m in PHONE.finditer(s):
            if 9 <= len(DIGITS.findall(m.group())) <= 15:
                out.append(("phone", at + m.start(), at + m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def fits(kind: str, instance: str) -> bool:
    """Whether a string could be an identifier of the kind."""
    digits = len(DIGITS.findall(instance))
    if "@" in instance:
        return kind == "email"
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "card":
        return 12 <= digits <= 19
    return kind == "ip" and instance.count(".") == 3


def short(s: str) -> str:
    """The text itself, or a hash of all of it where it is long."""
    return s if len(s) <= LONG else f"#{xxhash.xxh3_64_hexdigest(s.encode('utf-8', 'replace'))}"


def clean(word: str) -> str:
    return short(re.sub(r"[0-9]+", "0", word.lower()).strip(".,;:!?|\"'()[]<>"))


def shape(instance: str) -> str:
    """Digits as 0, runs of letters as a, all else as it is."""
    return short(re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "0", instance)))


def with_contexts(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, list[str]]]:
    """(instance, contexts) of each span, in time linear in the text.

    Patterns are the word before, the two words before, the words on both sides,
    and the ending of the word before with the instance's shape. Words are taken
    whole; of a word that a span lies in, what is before and after the span
    counts, up to its neighbour. ``spans`` come by start.
    """
    if not spans:
        return
    words = [m.span() for m in WORD.finditer(text)]
    starts, cleaned = [a for a, _ in words], {}

    def word(i: int) -> str:
        if i not in cleaned:
            cleaned[i] = clean(text[slice(*words[i])]) if 0 <= i < len(words) else "^" if i < 0 else "$"
        return cleaned[i]

    edge = 0
    for n, (a, b) in enumerate(spans):
        i = bisect_right(starts, a) - 1
        part = clean(text[max(words[i][0], edge) : a])
        one, two = (part, word(i - 1)) if part else (word(i - 1), word(i - 2))
        j = bisect_right(starts, b - 1) - 1
        follows = spans[n + 1][0] if n + 1 < len(spans) else len(text)
        right = clean(text[b : min(words[j][1], max(b, follows))]) or word(j + 1)
        edge = max(edge, b)
        instance = text[a:b]
        yield instance, [f"1 {one}", f"2 {two} {one}", f"3 {one} _ {right}", f"4 {one[-3:]} {shape(instance)}"]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Identifier-like strings that overlap no base span, by start, in linear time."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        m = AROUND.match(text, at + 1)
        start = at
        while m and start > end and AROUND.match(text, start - 1, start):
            start -= 1
        if m and start < at:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    taken = sorted([*found, *((a, b) for _, a, b in base)])
    found, i, end = [(a, b, True) for a, b in found], 0, 0
    for m in LOOSE.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            end, i = max(end, taken[i][1]), i + 1
        if end <= m.start():
            found.append((*m.span(), False))
    out, i, end = [], 0, 0
    for a, b, mail in sorted(found):
        while mail and i < len(base) and base[i][1] < b:
            end, i = max(end, base[i][2]), i + 1
        s = text[a:b].rstrip(".-")
        if (not mail or end <= a) and len(s) >= 7 and any(fits(k, s) for k in KINDS):
            out.append((a, a + len(s)))
    return out


def instances(text: str) -> Iterator[tuple[str, str | None, list[str]]]:
    """(instance, its base kind if any, contexts) of a text."""
    base = base_spans(text)
    spans = sorted([(a, b, k) for k, a, b in base] + [(a, b, "") for a, b in candidates(text, base)])
    for (_, _, kind), (instance, around) in zip(spans, with_contexts(text, [(a, b) for a, b, _ in spans]), strict=True):
        yield instance, kind or None, around


def edges(docs: DataFrame) -> DataFrame:
    """(context, instance, kind): the graph; kind is null for mere candidates.

    An instance is a 64-bit hash of the whole string.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in as_text(pdf["text"]):
                for instance, kind, around in instances(text):
                    h = xxhash.xxh3_64_intdigest(instance.encode("utf-8", "replace")) - (1 << 63)
                    out += [(c, h, kind) for c in around]
            yield pd.DataFrame(out, columns=["context", "instance", "kind"])

    return docs.select("text").mapInPandas(run, "context string, instance long, kind string").distinct()


def learn_contexts(docs: DataFrame, rounds: int = 3, least: int = 4, accept: float = 0.8) -> DataFrame:
    """(context, kind, p): a written table of all contexts to trust.

    A context needs ``least`` distinct known instances of a kind; its score is
    their summed scores over one more than all its instances. Instances gain
    1 - product(1 - score) over the contexts accepted in the round before. Only
    aggregates are shuffled, pre-aggregated by context and by instance.
    """
    graph = spool(edges(docs), "contexts")
    pairs = graph.select("context", "instance").distinct()
    sizes = pairs.groupBy("context").agg(F.count("*").alias("size"))
    seeds = graph.filter("kind is not null").select("instance", "kind").distinct().withColumn("s", F.lit(1.0))
    seeded = graph.filter("kind is not null").select("instance", "kind", "context")
    known, accepted = seeds, None
    for turn in range(rounds):
        links = seeded.withColumn("s", F.lit(1.0)) if turn == 0 else pairs.join(known, "instance")
        score = links.groupBy("context", "kind").agg(F.sum("s").alias("sum"), F.count("*").alias("n"))
        accepted = (
            score.filter(F.col("n") >= least)
            .join(sizes, "context")
            .select("context", "kind", (F.col("sum") / (F.col("size") + 1)).alias("p"))
            .filter(F.col("p") >= accept)
        )
        accepted = spool(accepted, f"accepted{turn}")
        if turn + 1 < rounds:
            gain = pairs.join(accepted, "context").groupBy("instance", "kind")
            found = gain.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("s"))
            known = spool(found.join(seeds, ["instance", "kind"], "left_anti").unionByName(seeds), f"known{turn}")
    return accepted


def all_spans(text: str, trusted: dict[tuple[str, str], float], accept: float = 0.8) -> tuple[list[Span], list[Span]]:
    """Base spans, and those together with what trusted contexts mark."""
    base = base_spans(text)
    more = []
    spans = candidates(text, base) if trusted else []
    for (a, b), (s, around) in zip(spans, in_company(text, base, spans), strict=True):
        best = max((trusted.get((c, k), 0.0), -i) for i, k in enumerate(KINDS) if fits(k, s) for c in around)
        if best[0] >= accept:
            more.append((KINDS[-best[1]], a, b))
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def in_company(text: str, base: list[Span], spans: list[tuple[int, int]]) -> Iterator[tuple[str, list[str]]]:
    """The contexts of candidates as the graph has them, among base spans."""
    every = sorted([(a, b, True) for _, a, b in base] + [(a, b, False) for a, b in spans]) if spans else []
    for (_, _, known), found in zip(every, with_contexts(text, [(a, b) for a, b, _ in every]), strict=True):
        if not known:
            yield found


def marks(texts: DataFrame, accepted: DataFrame) -> DataFrame:
    """(key, marks) of the texts (key, text) in which accepted contexts mark something.

    The same choice as in ``all_spans``: of all contexts and kinds that fit the
    best score, then the kind that is listed first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"], as_text(pdf["text"]), strict=True):
                base = base_spans(text)
                spans = candidates(text, base)
                for (a, b), (s, around) in zip(spans, in_company(text, base, spans), strict=True):
                    kinds = [(i, k) for i, k in enumerate(KINDS) if fits(k, s)]
                    out += [(key, a, b, c, k, -i) for c in around for i, k in kinds]
            yield pd.DataFrame(out, columns=["key", "a", "b", "context", "kind", "i"])

    each = texts.mapInPandas(run, "key binary, a int, b int, context string, kind string, i int")
    best = each.join(accepted, ["context", "kind"]).groupBy("key", "a", "b").agg(F.max(F.struct("p", "i", "kind")).alias("best"))
    return best.groupBy("key").agg(F.collect_list(F.struct("best.kind", "a", "b")).alias("marks"))


def apply_spans(own: DataFrame, text: str, accepted: DataFrame, name: str, make: Callable[[str | None, list[Span], list[Span]], object], kind: str) -> DataFrame:
    """``own`` and a column ``name``: make(text, base spans, all spans).

    While the accepted contexts are counted to be few, every task holds them.
    Otherwise they are joined to the candidates of each distinct text, and what
    they mark is joined to the rows by a digest of the text.
    """
    if accepted.count() <= FEW:
        trusted = {(r["context"], r["kind"]): r["p"] for r in accepted.collect()}

        @F.pandas_udf(kind)
        def found(texts: pd.Series) -> pd.Series:
            given = (t if isinstance(t, str) else None for t in texts)
            return pd.Series([make(t, *all_spans(t or "", trusted)) for t in given], dtype=object)

        return own.withColumn(name, found(F.col(text)))
    key = F.unhex(F.sha2(F.col(text), 256))
    marked = marks(own.select(key.alias("key"), F.col(text).alias("text")).filter("text is not null").distinct(), accepted)

    @F.pandas_udf(kind)
    def found_marks(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for t, m in zip((t if isinstance(t, str) else None for t in texts), more, strict=True):
            base = base_spans(t or "")
            spans = [] if m is None else [(x["kind"], int(x["a"]), int(x["b"])) for x in m]
            out.append(make(t, base, sorted(base + spans, key=lambda x: (x[1], KINDS.index(x[0])))))
        return pd.Series(out, dtype=object)

    rows = own.withColumn("key", key).join(marked, "key", "left")
    return rows.select(*own.columns, found_marks(F.col(text), "marks").alias(name))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, spans): joined base spans and all spans of whole texts.

    Offsets are code points, ends exclusive. Null and empty texts have none;
    repeated rows give repeated rows, and count once in the graph; an empty
    table gives none. Other columns, whatever their names, are not read.
    """
    docs = pick(docs, "doc_id", "text")
    both = lambda t, base, spans: f"{joined(base)};{joined(spans)}"
    found = apply_spans(docs, "text", learn_contexts(docs, **options), "found", both, "string")
    each = F.split("found", ";")
    return found.select("doc_id", each[0].alias("base"), each[1].alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets.

    Of overlapping spans the one that starts first, or else is first in order,
    names the kind; the whole overlap goes. Other columns stay; null texts stay.
    Rows go by their texts alone, whatever their ids.
    """
    names = docs.columns
    own = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    text = f"_c{names.index('text')}"

    def clean(value: str | None, base: list[Span], spans: list[Span]) -> str | None:
        if value is None:
            return None
        out, end = [], 0
        for kind, a, b in spans:
            if a >= end:
                out += [value[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join([*out, value[end:]])

    out = apply_spans(own, text, learn_contexts(pick(docs, "text"), **options), "_clean", clean, "string")
    return out.select(*("_clean" if c == text else c for c in own.columns)).toDF(*names)
