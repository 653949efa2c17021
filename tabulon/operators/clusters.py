"""Cluster sizes, match scores and outliers."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, float_of, float_text, rounded, text
from ..sources.readers import require_columns

# Upper ends of the size buckets and their labels.
BUCKETS = [(1, "1"), (5, "2-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"), (250, "101-250"), (500, "251-500")]


def size_bucket(n: Column) -> Column:
    out = F
    for end, label in BUCKETS:
        out = out.when(n <= end, label)
    return out.otherwise("500+")


def summarize_clusters(
    df: DataFrame, cluster_column: str, match_columns: list[str] | None = None, match_prefix: str | None = None,
    large_cluster_size: int = 10, low_match_score: float = 0.85,
) -> DataFrame:
    """(cluster_id, size, size_bucket, average_match_score, outlier_score, outlier_reason).

    The average is pooled over rows and match columns, of values that are
    numbers; null without any. Listed match columns that are absent are ignored.
    """
    require_columns(df, cluster_column)
    names = match_columns or ([c for c in df.columns if c.startswith(match_prefix)] if match_prefix else [])
    scores = [float_of(as_text(df, c)) for c in dict.fromkeys(names) if c in df.columns]
    add = lambda cols, start: functools.reduce(operator.add, cols, F.lit(start))
    rows = df.select(
        text(df, cluster_column).alias("cluster_id"),
        add([F.coalesce(s, F.lit(0.0)) for s in scores], 0.0).alias("s"),
        add([s.isNotNull().cast("long") for s in scores], 0).alias("k"),
    )
    one = rows.filter("cluster_id <> ''").groupBy("cluster_id").agg(F.count("*").alias("size"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    size, avg = F.col("size"), F.when(F.col("k") > 0, F.col("s") / F.col("k"))
    large, low = size >= large_cluster_size, avg < low_match_score
    score = F.when(large, F.least(F.lit(1.0), size / F.lit(float(large_cluster_size))) * 0.5).otherwise(0.0)
    score = score + F.when(low, F.least(F.lit(1.0), low_match_score - avg + 0.5) * 0.5).otherwise(0.0)
    return one.select(
        "cluster_id", "size", size_bucket(size).alias("size_bucket"), avg.alias("average_match_score"),
        F.least(F.lit(1.0), score).alias("outlier_score"),
        F.concat_ws("|", F.when(large, "large_cluster"), F.when(low, "low_match_score")).alias("outlier_reason"),
    ).orderBy(F.desc("size"), "cluster_id")


def flat_clusters(summary: DataFrame) -> DataFrame:
    avg = F.coalesce(float_text(rounded(F.col("average_match_score"))), F.lit(""))
    return summary.withColumn("average_match_score", avg).withColumn("outlier_score", rounded(F.col("outlier_score")))
