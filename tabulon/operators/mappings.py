"""One-to-many checks: values on the left that map to several on the right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..sources.readers import require_columns


def find_one_to_many_mappings(df: DataFrame, left_column: str, right_column: str, ignore_blank: bool = True) -> DataFrame:
    """(left_value, right_count, right_values), most values first and then by left value."""
    require_columns(df, left_column, right_column)
    pairs = df.select(text(df, left_column).alias("left_value"), text(df, right_column).alias("r"))
    if ignore_blank:
        pairs = pairs.filter("left_value <> '' and r <> ''")
    # Distinct pairs first: a hot left value is spread by its right values.
    groups = pairs.distinct().groupBy("left_value").agg(F.array_sort(F.collect_list("r")).alias("right_values"))
    out = groups.filter(F.size("right_values") > 1)
    return out.select("left_value", F.size("right_values").cast("long").alias("right_count"), "right_values").orderBy(F.desc("right_count"), "left_value")


def flat_mappings(issues: DataFrame) -> DataFrame:
    return issues.withColumn("right_values", F.array_join("right_values", "|"))
