"""A record, and the others of its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..sources.readers import POSITION, require_columns, with_position


def lookup_entity(df: DataFrame, id_column: str, id_value: str, cluster_column: str | None = None, order_by: str | None = None) -> DataFrame:
    """Rows with the id, and the siblings of the first one's cluster, in input order."""
    require_columns(df, id_column, *([cluster_column] if cluster_column else []))
    names = [c for c in df.columns if c != POSITION]
    at = with_position(df, order_by)
    hit = text(at, id_column) == id_value
    if cluster_column is None:
        out = at.filter(hit).withColumn("_lookup_relationship", F.lit("match"))
        return out.orderBy(POSITION).select(*(f"`{c}`" for c in names), "_lookup_relationship")
    first = at.filter(hit).agg(F.min_by(text(at, cluster_column), F.col(POSITION)).alias("_lookup_cluster"))  # one row
    own = text(at, cluster_column)
    out = at.join(F.broadcast(first), hit | ((own == F.col("_lookup_cluster")) & (own != "")))
    out = out.filter(F.col("_lookup_cluster").isNotNull())
    out = out.withColumn("_lookup_relationship", F.when(hit, "match").otherwise("cluster_sibling"))
    return out.orderBy(POSITION).select(*(f"`{c}`" for c in names), "_lookup_relationship", "_lookup_cluster")
