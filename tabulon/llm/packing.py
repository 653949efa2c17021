"""Packing documents into sequences by first-fit decreasing.

Documents are dealt into random groups of bounded size, and each group is packed
by itself. Full sequences are cut from the front of long documents; the tails
are placed, longest first, each in the first bin that has room. A tournament
tree over the bins' capacities finds that bin in logarithmic time: each inner
node holds the greater capacity of its children.

A sequence whose length is a power of two needs no padding, so what would leave
a bin poorly filled is cut into lengths that are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, pick
from .tokens import crc, encoder, narrow, wide

#: Documents and bytes of text of a group, about; bits of a sequence_id that
#: number the sequences of a group.
GROUP, GROUP_BYTES, SHIFT = 1024, 8 << 20, 32


class Tournament:
    """First bin with room for a length, over up to ``n`` bins."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)
        self.capacity, self.used = capacity, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset there); a length beyond the capacity is an error."""
        room, i = self.room, 1
        while i < self.leaves:
            i = 2 * i if room[2 * i] >= length else 2 * i + 1
        bin_, offset = i - self.leaves, self.capacity - room[i]
        room[i] -= length
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        self.used = max(self.used, bin_ + 1)
        return bin_, offset


def first_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """Bins of (item, offset), by first-fit decreasing; ties in order of items."""
    tree = Tournament(max(1, len(lengths)), capacity)
    bins: list[list[tuple[int, int]]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b, offset = tree.place(lengths[item])
        while len(bins) <= b:
            bins.append([])
        bins[b].append((item, offset))
    return bins


def unpadded(size: int, capacity: int, spare: int) -> list[int]:
    """Lengths of the sequences that a bin's content becomes.

    One if it is a power of two or at most ``spare`` short of the capacity; else
    the powers of two that sum to it, largest first.
    """
    if size & (size - 1) == 0 or capacity - size <= spare:
        return [size]
    return [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, spare: int = 32, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``with_ids``, ids: the piece's as little-endian unsigned 32-bit integers.)
    Null texts are empty: the end id alone. Repeated rows are documents of their
    own; of null doc_ids each row is dealt by its place. An empty table gives no
    pieces.

    A group has ``GROUP`` documents and ``GROUP_BYTES`` of text, about; without
    ``with_ids`` only the checksums of full pieces go to it.
    """
    docs = pick(docs, "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // GROUP), -(-(size or 0) // GROUP_BYTES))

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, row = encoder(tokenizer), 0
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], as_text(pdf["text"]), strict=True):
                ids = encode(text) + end
                cut, step = len(ids) // (4 * capacity) * 4 * capacity, 4 * capacity
                checks = np.array([crc(ids[i : i + step]) for i in range(0, cut, step)], "<u4").tobytes()
                full = narrow(ids[:cut]) if with_ids else b""
                out.append((doc_id, len(ids) // 4, checks, full, narrow(ids[cut:]), row))
                row += 1
            out = pd.DataFrame(out, columns=["doc_id", "doc_tokens", "checks", "full", "tail", "row"])
            yield out.astype({"doc_id": "Int64"})

    tokens = docs.mapInPandas(tokenize, "doc_id long, doc_tokens long, checks binary, full binary, tail binary, row long")
    # Rows without an id are told apart by their place in the input.
    place = F.when(F.col("doc_id").isNull(), F.col("row"))
    tokens = tokens.withColumn("g", F.pmod(F.xxhash64("doc_id", place, F.lit(10)), F.lit(groups)))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_tokens", "row"], kind="stable").reset_index(drop=True)
        ids_of, totals = pdf["doc_id"].astype("Int64").tolist(), pdf["doc_tokens"].tolist()
        sequence, out = int(key[0]) << SHIFT, []
        for i, checks in enumerate(pdf["checks"]):
            full = wide(pdf["full"][i]).astype("<u4").tobytes() if with_ids else b""
            for at, check in enumerate(np.frombuffer(checks, "<u4").tolist()):
                ids = full[4 * at * capacity : 4 * (at + 1) * capacity]
                out.append((ids_of[i], at * capacity, capacity, check, totals[i], sequence, 0, ids))
                sequence += 1
        tails = [(i, wide(t).astype("<u4").tobytes()) for i, t in enumerate(pdf["tail"]) if len(t) > 1]
        for content in first_fit([len(t) // 4 for _, t in tails], capacity):
            lengths = unpadded(sum(len(tails[k][1]) // 4 for k, _ in content), capacity, spare)
            left, offset = lengths.pop(0), 0
            for k, _ in content:
                i, t = tails[k]
                at = 0
                while at < len(t):
                    if not left:
                        sequence, offset, left = sequence + 1, 0, lengths.pop(0)
                    ids = t[at : at + 4 * left]
                    n = len(ids) // 4
                    out.append((ids_of[i], totals[i] - (len(t) - at) // 4, n, crc(ids), totals[i], sequence, offset, ids))
                    at, left, offset = at + len(ids), left - n, offset + n
            sequence += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        pieces = pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        return pieces if with_ids else pieces.drop(columns="ids")

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.groupBy("g").applyInPandas(pack, kind + ", ids binary" * with_ids)
