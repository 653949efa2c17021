"""Differences of membership between two exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..sources.readers import POSITION, require_columns, with_position

EMPTY = "array<string>"


def membership(df: DataFrame, id_column: str, member_column: str, order_by: str | None = None) -> DataFrame:
    """(id, member, pos) of stripped, filled pairs, each once; pos is the id's first position."""
    require_columns(df, id_column, member_column)
    df = with_position(df, order_by)
    rows = df.select(text(df, id_column).alias("id"), text(df, member_column).alias("member"), F.col(POSITION).alias("p"))
    rows = rows.filter("id <> '' and member <> ''").groupBy("id", "member").agg(F.min("p").alias("p"))
    first = rows.groupBy("id").agg(F.min("p").alias("pos"))
    return rows.drop("p").join(first, "id")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids whose members differ, from two memberships: a full outer join on the id."""
    sets = lambda df, c: df.groupBy("id").agg(F.array_sort(F.collect_list("member")).alias(c))
    both = sets(old, "old_members").join(sets(new, "new_members"), "id", "full")
    a, b = F.col("old_members"), F.col("new_members")
    kind = F.when(b.isNull(), "removed").when(a.isNull(), "added").when(F.size(a) != F.size(b), "member_count_changed").otherwise("members_changed")
    out = both.filter(~a.eqNullSafe(b)).withColumn("difference", kind)
    none = F.array().cast(EMPTY)
    return out.select("id", "difference", F.coalesce(a, none).alias("old_members"), F.coalesce(b, none).alias("new_members"))


def narratives(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members that moved, ids that split and ids that merged, with ``section`` 1 to 3."""
    owner = lambda df, c: df.groupBy("member").agg(F.max_by("id", F.struct("pos", "id")).alias(c))
    old_of, new_of = owner(old, "old_id"), owner(new, "new_id")
    moved = old_of.join(new_of, "member").filter("old_id <> new_id").select(
        F.col("member").alias("id"), F.lit("member_reassigned").alias("difference"), F.array("old_id").alias("old_members"), F.array("new_id").alias("new_members"), F.lit(1).alias("section")
    )
    spread = lambda df, to, c: df.join(to, "member", "left").groupBy("id").agg(
        F.array_sort(F.collect_set("member")).alias("members"), F.array_sort(F.collect_set(c)).alias("ids")
    ).filter(F.size("ids") > 1)
    split = spread(old, new_of, "new_id").select("id", F.lit("split").alias("difference"), F.col("members").alias("old_members"), F.col("ids").alias("new_members"), F.lit(2).alias("section"))
    merged = spread(new, old_of, "old_id").select("id", F.lit("merged").alias("difference"), F.col("ids").alias("old_members"), F.col("members").alias("new_members"), F.lit(3).alias("section"))
    return moved.unionByName(split).unionByName(merged)


def compare_export_membership(old: DataFrame, new: DataFrame, id_column: str, member_column: str, include_narratives: bool = False, order_by: str | None = None) -> DataFrame:
    """(id, difference, old_members, new_members): drift, then the narratives in their order."""
    a, b = (membership(df, id_column, member_column, order_by) for df in (old, new))
    out = drift(a, b).withColumn("section", F.lit(0))
    if include_narratives:
        out = out.unionByName(narratives(a, b))
    return out.orderBy("section", "id").drop("section")


def flat_differences(result: DataFrame) -> DataFrame:
    return result.withColumn("old_members", F.array_join("old_members", "|")).withColumn("new_members", F.array_join("new_members", "|"))
