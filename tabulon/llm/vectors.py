"""Blocks of vectors: every query block meets every shard of rows once."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Rows of a shard and queries of a block: what one task holds at most, times dims.
SHARD_ROWS, BLOCK_QUERIES = 16384, 8192


def clean(df: DataFrame, id_column: str, vector_column: str, drop_zero: bool) -> DataFrame:
    """(id, v) of the rows that take part.

    Null ids and vectors, and vectors with null or non-finite components, take
    no part; nor, with ``drop_zero``, do vectors without a non-zero component.
    """
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    df = pick(df, id_column, vector_column).toDF("id", "v")
    df = df.select("id", v.cast("array<double>").alias("v"))
    df = df.filter(F.col("id").isNotNull() & v.isNotNull()).filter(~odd)
    return df.filter(F.exists(v, lambda x: x != 0)) if drop_zero else df


def matrix(vectors, dims: int) -> np.ndarray:
    """Rows of doubles; a shorter vector counts as having zeros at its end."""
    out = np.zeros((len(vectors), dims))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def distinct_ids(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per id, in ascending order of ids.

    Of repeated rows one counts; of different vectors under one id the one
    that is first in order counts, so that reruns agree.
    """
    pdf = pdf.sort_values("id", kind="stable")
    if pdf["id"].is_unique:
        return pdf
    keyed = pdf.assign(k=[tuple(x) for x in pdf["v"]]).sort_values(["id", "k"], kind="stable")
    return keyed.drop_duplicates("id").drop(columns="k")


def scatter_gather(
    rows: DataFrame,
    queries: DataFrame,
    n_rows: int,
    n_queries: int,
    search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run ``search(rows of a shard, queries of a block)`` for each shard and block.

    Both are dealt by a hash of the id, so no value of a vector, however common,
    makes a shard large. A task holds one shard and one block of bounded size.
    """
    shards = max(1, math.ceil(n_rows / SHARD_ROWS))
    blocks = max(1, math.ceil(n_queries / BLOCK_QUERIES))
    at = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", F.pmod(at, F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(at, F.lit(blocks)).cast("int")).withColumn("shard", every(shards))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search(distinct_ids(a), distinct_ids(b))

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, schema)


def best(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k best of each query over all shards; ties go to the smaller id."""
    ranked = F.slice(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k
    )  # at most k from each shard
    out = found.groupBy("query_id").agg(ranked.alias("top")).select("query_id", F.posexplode("top").alias("p", "t"))
    return out.select(
        "query_id",
        (F.col("p") + 1).cast("int").alias("rank"),
        F.col("t.vec_id").alias("vec_id"),
        (-F.col("t.s")).cast(score_type).alias("score"),
    )
