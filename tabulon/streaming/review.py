"""Review checks over streams: an extension, as the same aggregations kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, float_of, text
from ..operators.clusters import size_bucket


def stream_mapping_counts(df: DataFrame, left_column: str, right_column: str) -> DataFrame:
    """Right values per left value so far, approximate in bounded state; for update or complete mode."""
    pairs = df.select(text(df, left_column).alias("left_value"), text(df, right_column).alias("r")).filter("left_value <> '' and r <> ''")
    return pairs.groupBy("left_value").agg(F.approx_count_distinct("r").alias("right_count")).filter("right_count > 1")


def stream_cluster_summary(df: DataFrame, cluster_column: str, score_column: str) -> DataFrame:
    """Size and mean score of clusters so far; for update or complete mode."""
    rows = df.select(text(df, cluster_column).alias("cluster_id"), float_of(as_text(df, score_column)).alias("x")).filter("cluster_id <> ''")
    out = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("x").alias("average_match_score"))
    return out.withColumn("size_bucket", size_bucket(F.col("size")))


def stream_windowed_counts(df: DataFrame, time_column: str, key_column: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per key and window; rows later than the watermark are left out. For append mode."""
    at = df.withColumn("_at", F.col(f"`{time_column}`").cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", window).alias("w"), text(df, key_column).alias("key")).agg(F.count("*").alias("n")).select("w.start", "w.end", "key", "n")
