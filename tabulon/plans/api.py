"""Python entry points over DataFrames and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clusters import summarize_clusters
from ..operators.compare import compare_export_membership
from ..operators.duplicates import find_duplicate_candidates
from ..operators.mappings import find_one_to_many_mappings
from ..operators.profile import profile_columns
from ..sources.readers import from_pandas, read_table

ENGINES = ("spark", "python")


def frame(data, engine: str) -> DataFrame:
    """A Spark DataFrame as it is, a pandas one converted."""
    if engine not in ENGINES:
        raise ValueError(f"Unsupported API engine: {engine}")
    if isinstance(data, DataFrame):
        return data
    return from_pandas(SparkSession.active(), data)


def profile(dataframe, engine: str = "spark") -> DataFrame:
    return profile_columns(frame(dataframe, engine))


def profile_path(path: str, format: str | None = None, encoding: str = "utf-8", delimiter: str = ",", sheet_name: str | int = 0, engine: str = "spark") -> DataFrame:
    return profile(read_table(SparkSession.active(), path, format, encoding, delimiter, sheet_name), engine)


def find_duplicates(dataframe, block: str, match: list[str], id_column: str | None = None, threshold: float = 0.85, scorer="auto", normalization: str = "basic", engine: str = "spark") -> DataFrame:
    return find_duplicate_candidates(frame(dataframe, engine), block, match, id_column, threshold, scorer, normalization)


def mapping_conflicts(dataframe, left: str, right: str, engine: str = "spark") -> DataFrame:
    return find_one_to_many_mappings(frame(dataframe, engine), left, right)


def compare_exports(old, new, id_column: str, member_column: str, include_narratives: bool = False, engine: str = "spark") -> DataFrame:
    return compare_export_membership(frame(old, engine), frame(new, engine), id_column, member_column, include_narratives)


def cluster_summary(dataframe, cluster: str, match_columns: list[str] | None = None, match_prefix: str | None = None, engine: str = "spark") -> DataFrame:
    return summarize_clusters(frame(dataframe, engine), cluster, match_columns, match_prefix)
