"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for each n-gram, one entry for every level up to the logarithm
of its count, so a count is read back by probing level after level until one is
missing. Unigrams and bigrams have a filter each. No task holds a whole filter:
each hash range makes the segments of its own n-grams, as many as its entries
need, and answers the probes of all batches of documents in that range. n-grams
of all counts are held, and the filters grow with the input.

A word's probability mixes what the context predicts with the word's own rate:

    p(w | h) = l(h) * c(h w) / c(h) + (1 - l(h)) * (c(w) + 1) / Z

with counts read from the filters, the least count of a level above and the
greatest below the line, so that predictions of a context sum to one at most. The
weight l depends on the level of c(h) and is fitted to all training texts, each
token scored as if it had not been counted.

The distinct words and bigrams of a batch of documents are sent once each, with
their counts, to the hash ranges they belong to. Each range returns a level for
each of them, and exact counts of words for the add-one baseline.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, pick, spool
from .words import MIX, hashed_words, mixed, runs

#: Hashes of the token that ends a text and of the context before its first word.
END, START = np.uint64(0x51F42D4C957F2D), np.uint64(0x057B7EF767814F)
#: Hashes have 56 bits: seven bytes where they are packed.
MASK = np.uint64((1 << 56) - 1)
#: Characters of text packed together, and bytes of text of a hash range, about.
TOGETHER, RANGE_BYTES = 8 << 20, 32 << 20
#: Probes of an entry, bits for it, and bits of one segment of a filter.
PROBES, ENTRY_BITS, SEGMENT_BITS = 5, 12, 1 << 19
LEVELS = 48
GRID = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98])


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order, each text's last being END, and their numbers."""
    each = [hashed_words(texts[part]) for part in runs(texts)]
    own, sizes = (np.concatenate(x) for x in zip(*each, strict=True))
    out = np.empty(len(own) + len(sizes), np.uint64)
    out[np.arange(len(own)) + np.repeat(np.arange(len(sizes)), sizes)] = own & MASK
    sizes = sizes + 1
    out[np.cumsum(sizes) - 1] = END
    return out, sizes


def bigrams(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(before * MIX + h) & MASK


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of equal width over the hashes, in order."""
    return ((h >> np.uint64(24)) * np.uint64(n)) >> np.uint64(32)


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each integer, all first bytes before all second ones.

    High bytes are zero almost everywhere, and so what is sent is compressed well.
    """
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def sorted_planes(h: np.ndarray) -> bytes:
    """Ascending hashes, as differences."""
    return planes(np.diff(h, prepend=np.uint64(0)), 7)


def from_sorted_planes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, 7), dtype=np.uint64)


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def least_of(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 2.0 ** (q - 1), 0.0)


def most_of(q: np.ndarray) -> np.ndarray:
    return 2.0**q - 1


def middle_of(q: np.ndarray) -> np.ndarray:
    return np.where(q > 1, 1.4 * 2.0 ** (q - 1), (q > 0) * 1.0)


def probe(g: np.ndarray, i: int) -> np.ndarray:
    """Place of the i-th probe within a segment."""
    return (g >> np.uint64(12 * i)) & np.uint64(SEGMENT_BITS - 1)


def entry(h: np.ndarray, q: int) -> np.ndarray:
    return mixed(h + np.uint64(q * int(MIX) & 0xFFFFFFFFFFFFFFFF))


def set_bits(h: np.ndarray, q: np.ndarray, first: int, segments: int, low: int, n: int) -> np.ndarray:
    """Bytes of the segments low to low + n with the entries of their n-grams."""
    bits = np.zeros(n * SEGMENT_BITS, bool)
    base = (bucket_of(h, segments) - np.uint64(low)) * np.uint64(SEGMENT_BITS)
    for lv in range(first, int(q.max(initial=0)) + 1):
        own = q >= lv
        g = entry(h[own], lv)
        for i in range(PROBES):
            bits[base[own] + probe(g, i)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """Levels of n-grams, read by repeated membership probes.

    ``data`` has the segments from ``low`` on.
    """

    data: np.ndarray
    segments: int
    first: int
    low: int = 0

    def levels(self, h: np.ndarray) -> np.ndarray:
        q, alive = np.zeros(len(h), np.int64), np.arange(len(h))
        base = (bucket_of(h, self.segments) - np.uint64(self.low)) * np.uint64(SEGMENT_BITS)
        for lv in range(self.first, LEVELS):
            g = entry(h[alive], lv)
            for i in range(PROBES):
                at = base + probe(g, i)
                got = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).view(bool)
                alive, base, g = alive[got], base[got], g[got]
            if not len(alive):
                break
            q[alive] = lv
        return q


def read_back(h: np.ndarray, counts: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Levels of the n-grams of a hash range as its part of the filter gives them."""
    q = level(counts)
    each = max(1, -(-int(q.sum()) * ENTRY_BITS // SEGMENT_BITS))
    held = counts > 0
    data = set_bits(h[held], q[held], 1, each * buckets, bucket * each, each)
    return Filter(data, each * buckets, 1, bucket * each).levels(h).astype(np.uint8)


def parts(before: np.ndarray, own: np.ndarray, pair: np.ndarray, z: float, left_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """(p from the context, p of the word alone) by levels of context, word and bigram.

    With ``left_out`` one occurrence is taken off each count.
    """
    one = 1.0 if left_out else 0.0
    seen = np.maximum(least_of(pair) - one, 0)
    p2 = np.minimum(1.0, np.where(before > 0, seen / np.maximum(most_of(before) - one, 1), 0))
    return p2, (np.maximum(middle_of(own) - one, 0) + 1) / z


def first_of(sizes: np.ndarray) -> np.ndarray:
    """Places of the first tokens of documents."""
    return np.cumsum(sizes) - sizes


def contexts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each; START before a document's first."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first_of(sizes)] = START
    return before


NGRAMS = "kind int, batch long, bucket int, n long, a binary, b binary"
NAMES = ["kind", "batch", "bucket", "n", "a", "b"]


def gather(docs: DataFrame, buckets: int) -> DataFrame:
    """n-grams by hash range, and what the ranges make of them.

    Rows (kind, batch, bucket, n, a, b): 0 a batch's documents and their tokens;
    1 and 2 the counts and levels of a batch's distinct words and bigrams in a
    range, in the order of their hashes; 3 how many words a range has, by level,
    under a batch of its own. A batch sends each distinct n-gram once with its
    count, so the commonest word brings a range one entry for each batch.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            train, texts = (pdf["held_out"] == 0).to_numpy(), as_text(pdf["text"])
            for rows in runs(texts, TOGETHER):
                number += 1
                h, sizes = tokens_of(texts[rows])
                own = np.repeat(train[rows], sizes)
                header = {
                    "doc_id": [None if pd.isna(x) else int(x) for x in pdf["doc_id"][rows]],
                    "held_out": [None if pd.isna(x) else int(x) for x in pdf["held_out"][rows]],
                    "n": sizes.tolist(),
                }
                head = json.dumps(header).encode()
                distinct, at, met = np.unique(h, return_inverse=True, return_counts=True)
                # Commonest words first: most tokens then have small numbers.
                order = np.argsort(-met, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                body = struct.pack("<II", len(head), len(order)) + head + planes(distinct[order], 7) + planes(place[at], 4)
                out = [(0, number, number % buckets, int(own.sum()), body, b"")]
                for kind, x, where in ((1, distinct, at), (2, *np.unique(bigrams(h, contexts(h, sizes)), return_inverse=True))):
                    n = np.bincount(where, weights=own, minlength=len(x)).astype(np.uint64)
                    edge = np.searchsorted(bucket_of(x, buckets), np.arange(buckets + 1))
                    for i, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist(), strict=False)):
                        if a < b:
                            out.append((kind, number, i, b - a, sorted_planes(x[a:b]), planes(n[a:b], 4)))
                yield pd.DataFrame(out, columns=NAMES)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in batches:
            yield pdf[pdf["kind"] == 0]
            held.append(pdf[pdf["kind"] > 0])
        if any(map(len, held)):
            yield answers(pd.concat(held).sort_values("batch"))

    def answers(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one kind and range, which is what a partition has beside documents."""
        kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
        x = np.concatenate([from_sorted_planes(a) for a in pdf["a"]])
        n = np.concatenate([from_planes(b, 4) for b in pdf["b"]])
        x, at = np.unique(x, return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(x)).astype(np.int64)
        q = read_back(x, count, bucket, buckets)
        out, end = [], 0
        for batch, size in zip(pdf["batch"], pdf["n"], strict=True):
            own = at[end : end + size]
            end += size
            out.append((kind, batch, bucket, size, planes(count[own], 7) if kind == 1 else b"", q[own].tobytes()))
        if kind == 1:
            by_level = np.bincount(q[count > 0], minlength=LEVELS).astype("<i8")
            out.append((3, -1 - bucket, bucket, int((count > 0).sum()), by_level.tobytes(), b""))
        return pd.DataFrame(out, columns=NAMES)

    # A partition for each kind and range, so that no two of them meet in a task.
    at = F.when(F.col("kind") == 2, F.col("bucket") + buckets).when(F.col("kind") == 1, F.col("bucket"))
    at = F.coalesce(at, F.pmod("batch", F.lit(2 * buckets))).cast("int")
    return docs.mapInPandas(send, NGRAMS).repartitionById(2 * buckets, at).mapInPandas(meet, NGRAMS)


def assemble(ngrams: DataFrame, texts: int) -> DataFrame:
    """Batches of documents with their logarithms and the levels of their tokens.

    (n, head, base, known, before, own, pair): training tokens, documents as
    JSON, sum of log10(count + 1) and known tokens of each, and levels of each
    token's context, word and bigram. Rows without a head have a range's words:
    their number n and, in base, how many there are of each level.
    """
    start = level(np.array([max(1, texts)]))[0]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["n", "head", "base", "known", "before", "own", "pair"]
        if pdf["kind"].iloc[0] == 3:
            return pd.DataFrame([(pdf["n"].iloc[0], None, pdf["a"].iloc[0], None, None, None, None)], columns=names)
        row, ranges = pdf[pdf["kind"] == 0].iloc[0], pdf.sort_values("bucket")
        head_size, n_words = struct.unpack_from("<II", row["a"])
        head, rest = row["a"][8 : 8 + head_size], row["a"][8 + head_size :]
        sizes = np.array(json.loads(head)["n"])
        words, at = from_planes(rest[: 7 * n_words], 7), from_planes(rest[7 * n_words :], 4).astype(np.int64)
        # Ranges are in the order of hashes.
        order, own_rows = np.argsort(words), ranges[ranges["kind"] == 1]
        count, q = np.empty(n_words, np.int64), np.empty(n_words, np.uint8)
        count[order] = np.concatenate([from_planes(a, 7) for a in own_rows["a"]]).astype(np.int64)
        q[order] = np.frombuffer(b"".join(own_rows["b"]), np.uint8)
        h, own, first = words[at], q[at], first_of(sizes)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = start
        pairs = np.frombuffer(b"".join(ranges["b"][ranges["kind"] == 2]), np.uint8)
        where = np.unique(bigrams(h, contexts(h, sizes)), return_inverse=True)[1]
        base = np.add.reduceat(np.log10(count + 1.0)[at], first)
        known = np.add.reduceat((count > 0)[at].astype(np.int64), first)
        out = (row["n"], head, base.astype("<f8").tobytes(), known.astype("<i8").tobytes(), before.tobytes(), own.tobytes(), pairs[where].tobytes())
        return pd.DataFrame([out], columns=names)

    rows = ngrams.groupBy("batch").applyInPandas(meet, "n long, head binary, base binary, known binary, before binary, own binary, pair binary")
    return spool(rows, "levels")


def levels_of(row) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).astype(np.int64) for x in (row.before, row.own, row.pair)]


def fit_weights(batches_of: DataFrame, z: float) -> np.ndarray:
    """For each level of a context, the weight that suits all training texts best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((LEVELS, len(GRID)))
        for pdf in batches:
            for row in pdf.itertuples():
                head = json.loads(row.head)
                train = np.repeat([x == 0 for x in head["held_out"]], head["n"])
                q, own, pair = (x[train] for x in levels_of(row))
                p2, p1 = parts(q, own, pair, z, True)
                for i, w in enumerate(GRID):
                    total[:, i] += np.bincount(q, weights=np.log(w * p2 + (1 - w) * p1), minlength=LEVELS)
        yield pd.DataFrame({"q": np.arange(LEVELS), "sums": list(total)})

    rows = batches_of.mapInPandas(run, "q int, sums array<double>")
    each = rows.select("q", F.posexplode("sums").alias("i", "s")).groupBy("q", "i").agg(F.sum("s").alias("s"))
    total = np.zeros((LEVELS, len(GRID)))
    for r in each.collect():
        total[r["q"], r["i"]] = r["s"]
    return GRID[np.argmax(total, axis=1)]


def score_texts(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learned from the rows whose crc32 of doc_id as text leaves another remainder
    than ``rest``. Tokens are words with ASCII letters lowered, then one end.
    Null and empty texts have the end alone; a null doc_id is never learned from
    and its held_out is null. Repeated rows give repeated rows. n-grams are
    told apart by 56-bit hashes.
    """
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(mod) == F.lit(rest)
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", left.cast("int").alias("held_out"))
    size, texts = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("held_out") == 0, 1))).first()
    buckets = max(8, -(-(size or 0) // RANGE_BYTES))
    found = assemble(gather(docs, buckets), texts)
    batches_of = found.filter("head is not null").drop("n")
    train_tokens = found.filter("head is not null").agg(F.sum("n")).first()[0] or 0
    vocabulary, count = 0, np.zeros(LEVELS, np.int64)
    for r in found.filter("head is null").select("n", "base").toLocalIterator():  # a row for each range
        vocabulary, count = vocabulary + r["n"], count + np.frombuffer(r["base"], "<i8")
    z = float((count[1:] * (middle_of(np.arange(1, LEVELS)) + 1)).sum() + 1)
    per_token = float(np.log10(train_tokens + vocabulary + 1))
    weight = fit_weights(batches_of, z)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                head = json.loads(row.head)
                n = np.array(head["n"])
                q, own, pair = levels_of(row)
                p2, p1 = parts(q, own, pair, z, False)
                w = weight[q]
                score = np.add.reduceat(np.log10(w * p2 + (1 - w) * p1), first_of(n))
                out = {"doc_id": head["doc_id"], "held_out": head["held_out"], "n_tokens": n, "n_known": np.frombuffer(row.known, "<i8")}
                out |= {"train_tokens": train_tokens, "base_score": np.frombuffer(row.base, "<f8") - per_token * n, "score": score}
                out = pd.DataFrame(out).astype({"doc_id": "Int64"})
                out["held_out"] = out["held_out"].map(lambda x: None if pd.isna(x) else bool(x)).astype(object)
                yield out

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return batches_of.mapInPandas(run, schema)
