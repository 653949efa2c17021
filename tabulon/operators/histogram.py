"""Histograms of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_text, col, float_of
from ..sources.readers import require_columns


def score_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of equal width from least to greatest, the last one closed.

    Empty bins have a row. A single value makes one bin; no values make none.
    """
    if bins <= 0:
        raise ValueError("bins must be positive")
    require_columns(df, column)
    # Numbers need no way through text.
    value = col(column).cast("double") if isinstance(df.schema[column].dataType, T.NumericType) else float_of(as_text(df, column))
    x = df.select(value.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))  # one row
    wide = (F.col("b") - F.col("a")) / bins
    place = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / wide))).otherwise(0).cast("int")
    counts = x.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    last = F.when(F.col("b") > F.col("a"), bins - 1).otherwise(0)
    all_ = ends.filter("a is not null").select("a", "b", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    out = all_.join(counts, "bin", "left").select(
        "bin", (F.col("a") + F.col("bin") * wide).alias("low"), F.when(F.col("bin") == last, F.col("b")).otherwise(F.col("a") + (F.col("bin") + 1) * wide).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
    return out.orderBy("bin")
