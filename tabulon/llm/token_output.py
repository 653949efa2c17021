"""Token ids in files: frequency ranks in byte-aligned variable-length codes.

Ids are replaced by their ranks by frequency over the whole corpus, so frequent
ids take one byte. A value takes one to four bytes; two bits of length per value
are kept apart in control bytes, four values to a control byte, so a reader turns
control bytes into lengths by one table lookup and all values by numpy gathers.

A file holds segments as rows: the part it belongs to, the ids before it in that
part, its documents with their lengths, control bytes and data bytes. The files
are Parquet, which gives the bytes to any file system that Spark writes, and
whose commit makes a lost executor harmless. The ranks are a table beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, parts_for, pick
from .tokens import crc, encoder, narrow, wide

#: Ids of a segment, about; documents are never split.
SEGMENT = 1 << 20
#: Lengths in bytes of the four values of each control byte, first value in the low bits.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document's unsigned 32-bit values.

    ``values`` are those of all documents, ``sizes`` how many each has. A
    document's control bytes start anew.
    """
    v = np.ascontiguousarray(values, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    fours = -(-sizes // 4)
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(fours)
    four = np.zeros(int(fours.sum()) * 4, np.uint8)
    four[np.arange(len(v)) + np.repeat(4 * (ends - fours) - starts, sizes)] = code
    four = four.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]].tobytes()
    bytes_ = np.r_[0, np.cumsum(code.astype(np.int64) + 1)][np.r_[0, np.cumsum(sizes)]]
    cuts = np.r_[0, ends]
    cut = lambda all_, at: [all_[a:b] for a, b in zip(at, at[1:], strict=False)]
    return cut(control, cuts), cut(data, bytes_)


def unpack(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """All values of the documents, by lookup of lengths and a gather per byte."""
    fours = -(-sizes // 4)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    starts = np.cumsum(sizes) - sizes
    own = np.arange(int(sizes.sum())) + np.repeat(4 * (np.cumsum(fours) - fours) - starts, sizes)
    size = lengths[own]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for i in (1, 2, 3):
        long = np.flatnonzero(size > i)
        out[long] |= raw[at[long] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, per_part: int = 20_000) -> None:
    """Tokenize whole texts and write them under ``path`` in ascending doc_id order.

    ``path/ids`` is a table of (doc_id, ids as bytes) with the counts of ids that
    each task met, ``path/ranks`` has (id, n), ``path/segments`` the encoded files. Null
    texts are empty: the end id alone. Null ids come first; rows of one doc_id
    follow each other by their ids.
    """
    spark, docs = docs.sparkSession, pick(docs, "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, total = encoder(tokenizer), np.zeros(1, np.int64)
        for pdf in batches:
            ids = [encode(t) + end for t in as_text(pdf["text"])]
            n = np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=len(total))
            n[: len(total)] += total
            total = n
            yield pd.DataFrame({"counts": None, "doc_id": pdf["doc_id"], "ids": [narrow(x) for x in ids]})
        yield pd.DataFrame({"counts": [total.astype("<i8").tobytes()], "doc_id": [None], "ids": [None]})

    made = docs.mapInPandas(tokenize, "counts binary, doc_id long, ids binary")
    made.write.option("compression", "zstd").parquet(f"{path}/ids")
    written = spark.read.parquet(f"{path}/ids")
    ids = written.filter("counts is null").select("doc_id", "ids")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf["counts"]:
                n = np.frombuffer(x, "<i8")
                at = np.flatnonzero(n)
                yield pd.DataFrame({"id": at, "n": n[at]})

    counts = written.filter("counts is not null").select("counts").mapInPandas(count, "id long, n long")
    counts.groupBy("id").agg(F.sum("n").alias("n")).write.parquet(f"{path}/ranks")
    by_rank = ranks(spark, path)  # as many as the tokenizer has ids
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    n = parts_for(spark, written.filter("counts is null").count(), per_part)

    # Dealt as they are and coded where they are written: finding the ranges reads all rows once more.
    placed = ids.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("ids"), "ids")
    placed = placed.withColumn("part", F.spark_partition_id())

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, held, size = 0, [], 0

        def row():
            ids_, each, part = zip(*held, strict=True)
            sizes = np.array([len(x) for x in each], np.int64)
            codes, data = pack(shared.value[np.concatenate(each)], sizes)
            return pd.DataFrame(
                {
                    "part": [part[0]],
                    "before": [before],
                    "n": [size],
                    "doc_ids": [list(ids_)],
                    "sizes": [sizes.astype("<u4").tobytes()],
                    "control": [b"".join(codes)],
                    "data": [b"".join(data)],
                }
            )

        for pdf in batches:
            ids_ = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            for doc_id, kept, part in zip(ids_, pdf["ids"], pdf["part"], strict=True):
                held.append((doc_id, wide(kept), part))
                size += len(held[-1][1])
                if size >= SEGMENT:
                    yield row()
                    before, held, size = before + size, [], 0
        if held:
            yield row()

    schema = "part int, before long, n long, doc_ids array<long>, sizes binary, control binary, data binary"
    placed.mapInPandas(segment, schema).write.option("compression", "zstd").parquet(f"{path}/segments")


def ranks(spark: SparkSession, path: str) -> np.ndarray:
    """Ids in descending order of frequency, ties by id."""
    rows = spark.read.parquet(f"{path}/ranks").orderBy(F.desc("n"), "id").select("id").collect()
    return np.array([r["id"] for r in rows], dtype=np.uint32)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Every id is decoded; ``start`` counts the ids of all documents before.
    """
    segments = spark.read.parquet(f"{path}/segments")
    sums = segments.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each part
    starts, total = {}, 0
    for r in sums:
        starts[r["part"]], total = total, total + r["n"]
    by_rank = spark.sparkContext.broadcast(ranks(spark, path))
    starts = spark.sparkContext.broadcast(starts)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                sizes = np.frombuffer(r.sizes, "<u4").astype(np.int64)
                v = by_rank.value[unpack(r.control, r.data, sizes)].astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts_ = starts.value[r.part] + r.before + ends - sizes
                checks = [crc(v[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends, strict=True)]
                ids = pd.array([None if pd.isna(x) else int(x) for x in r.doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids, "start": starts_, "n_tokens": sizes, "ids_crc32": checks})

    return segments.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
