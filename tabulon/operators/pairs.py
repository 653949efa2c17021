"""Columns that group rows, and columns that are equal on every row."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, rounded
from ..sources.readers import POSITION, with_position
from .profile import frequencies


def find_grouping_candidates(df: DataFrame, threshold: float = 0.5, order_by: str | None = None) -> DataFrame:
    """Columns whose most common value has ``threshold`` of the rows; the first seen wins a tie."""
    freq = frequencies(df, order_by=order_by)
    totals = freq.groupBy("column").agg(F.sum("n").alias("total_rows"), F.max_by("value", F.struct("n", -F.col("first_pos"))).alias("value"), F.max("n").alias("count"))
    ratio = F.col("count") / F.col("total_rows")
    out = totals.filter(ratio >= threshold)
    return out.orderBy(F.desc(ratio), "column").select("column", "value", "count", "total_rows", rounded(ratio).alias("ratio"))


def find_identical_column_pairs(df: DataFrame) -> DataFrame:
    """(left_column, right_column, compared_rows) of columns equal on every raw value.

    One aggregate makes a fingerprint of each column; only columns with equal
    fingerprints are compared exactly, in a second one.
    """
    spark, names = df.sparkSession, [c for c in df.columns if c != POSITION]
    df = with_position(df)
    schema = "left_column string, right_column string, compared_rows long"
    row = F.col(POSITION)
    prints = [F.bit_xor(F.xxhash64(as_text(df, c), row)).alias(f"p{i}") for i, c in enumerate(names)]
    got = df.agg(F.count("*").alias("n"), *prints).first()
    same = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if got["n"] and got[f"p{i}"] == got[f"p{j}"]]
    if not same:
        return spark.createDataFrame([], schema)
    sure = df.agg(*(F.bool_and(as_text(df, names[i]) == as_text(df, names[j])).alias(f"s{k}") for k, (i, j) in enumerate(same))).first()
    rows = [(names[i], names[j], got["n"]) for k, (i, j) in enumerate(same) if sure[f"s{k}"]]
    return spark.createDataFrame(rows, schema)
