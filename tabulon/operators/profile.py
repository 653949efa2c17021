"""Column profiles from one frequency table.

The columns are unpivoted and counted by (column, value) with the first position
of each value; parsing then happens once per distinct value, and all statistics
are weighted by the counts. One scan and one large shuffle, pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import float_text, marked_currency, moment_of, number_of, number_text, rounded, text
from ..sources.readers import POSITION, require_columns, with_position

# What counts as no value.
DUMMIES = ("", "0", "-1", "1900-01-01", "9999-12-31", "n/a", "na", "none", "null", "sample", "test", "undefined", "unknown")
TYPED = 0.75


def frequencies(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None) -> DataFrame:
    """(column, value, n, first_pos) over stripped text."""
    names = columns or [c for c in df.columns if c != POSITION]
    require_columns(df, *names)
    df = with_position(df, order_by)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), text(df, c).alias("value")) for c in names))
    long = df.select(POSITION, F.explode(pairs).alias("x")).select("x.column", "x.value", POSITION)
    return long.groupBy("column", "value").agg(F.count("*").alias("n"), F.min(POSITION).alias("first_pos"))


def leading(rows: DataFrame, k: int, order: list, *by: str) -> DataFrame:
    """The first ``k`` rows of each group, with their ``place``.

    The limit is on the rank itself, so each task sends at most ``k`` rows of a
    group on, and no task sorts all the values of a column.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def profile_columns(
    df: DataFrame, columns: list[str] | None = None, dummy_values: tuple | None = None, top_n: int = 10, order_by: str | None = None, exact: bool = True
) -> DataFrame:
    """One row per column, in the order of the columns.

    Blank counts as a distinct value. Ties among top values and invalid examples
    go to what is first seen. ``exact=False`` takes approximate quantiles, whose
    state is bounded whatever the number of distinct values.
    """
    names = columns or [c for c in df.columns if c != POSITION]
    freq = frequencies(df, names, order_by)
    v, n = F.col("value"), F.col("n")
    dummies = [d.lower() for d in (dummy_values or DUMMIES)]
    parsed = freq.select(
        "column", "value", "n", "first_pos",
        (v != "").alias("filled"), F.lower(v).isin(dummies).alias("dummy"),
    )
    parsed = parsed.withColumn("real", F.col("filled") & ~F.col("dummy"))
    # Columns of numbers were numbers before they were text, and fractions are no dates.
    numeric = F.col("column").isin([c for c in names if isinstance(df.schema[c].dataType, T.NumericType)])
    fraction = F.col("column").isin([c for c in names if isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType)])
    parsed = parsed.withColumn("x", F.when(F.col("real"), F.when(numeric, v.try_cast("double")).otherwise(number_of(v))))
    parsed = parsed.withColumn("d", F.when(F.col("real") & ~fraction, moment_of(v)))
    real, x, d = F.col("real"), F.col("x"), F.col("d")
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    quartile = (lambda: F.percentile(x, [0.25, 0.5, 0.75], n)) if exact else (lambda: F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000))
    listed = lambda rows, name, *fields: rows.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias(name))
    tops = listed(leading(freq, top_n, [F.desc("n"), "first_pos"], "column"), "tops", "value", "n")
    bad = [
        listed(leading(parsed.filter(real & ok.isNull() & may), 3, ["first_pos"], "column"), name, "value")
        for name, ok, may in (("bad_numbers", x, F.lit(True)), ("bad_moments", d, ~fraction))
    ]
    one = parsed.groupBy("column").agg(
        F.sum("n").alias("total_rows"), count(~F.col("filled")).alias("blank_count"), count(F.col("dummy")).alias("null_like_count"),
        F.count("*").alias("unique_count"), count(real).alias("meaningful"), count(x.isNotNull()).alias("numbers"),
        count(d.isNotNull()).alias("moments"), count(real & marked_currency(v)).alias("marks"),
        F.sum(F.when(real, 1).otherwise(0)).alias("kinds"),
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), quartile().alias("q"), F.min(d).alias("min_d"), F.max(d).alias("max_d"),
    )
    for more in (tops, *bad):  # one row a column each
        one = one.join(more, "column", "left")
    examples = lambda c: F.coalesce(F.transform(c, lambda s: s["value"]), F.array().cast("array<string>"))
    total, filled = F.col("total_rows"), F.col("total_rows") - F.col("blank_count")
    name = F.lower("column")
    is_id = (name.contains("id") | name.endswith("_key")) & (filled > 0) & (F.col("unique_count") == filled) & (total > 1)
    m = F.col("meaningful")
    rate = lambda c: F.when(m > 0, rounded(F.col(c) / m)).otherwise(0.0)
    currency = (F.col("numbers") > 0) & (F.col("marks") / F.greatest(m, F.lit(1)) >= 0.5)
    numeric, moment = (m > 0) & (rate("numbers") >= TYPED), (m > 0) & (rate("moments") >= TYPED)
    typed = (
        F.when(m == 0, "empty").when(numeric & currency, "currency").when(numeric, "numeric").when(moment, "datetime")
        .when(F.col("kinds") / F.greatest(m, F.lit(1)) <= 0.5, "categorical").otherwise("text")
    )
    only = lambda c: F.coalesce(F.when(numeric, number_text(c)), F.lit(""))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    edge = lambda a, b: F.coalesce(F.when(numeric, number_text(a)).when(moment, day(b)), F.lit(""))
    place = F.array_position(F.array(*(F.lit(c) for c in names)), F.col("column"))
    return one.orderBy(place).select(
        "column", "total_rows", "blank_count", "null_like_count", "unique_count",
        rounded(F.col("unique_count") / total).alias("unique_ratio"),
        F.transform(F.coalesce("tops", F.array().cast("array<struct<place:int,value:string,n:bigint>>")), lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))).alias("top_values"),
        is_id.alias("likely_unique_id"), F.when(is_id, "identifier").otherwise(typed).alias("inferred_type"),
        rate("numbers").alias("numeric_parse_rate"), rate("moments").alias("datetime_parse_rate"),
        (numeric & currency).alias("currency_like"),
        edge(F.col("min_x"), F.col("min_d")).alias("min_value"), edge(F.col("max_x"), F.col("max_d")).alias("max_value"),
        only(F.col("q")[0]).alias("q1"), only(F.col("q")[1]).alias("median"), only(F.col("q")[2]).alias("q3"),
        F.when(numeric, examples("bad_numbers")).when(moment, examples("bad_moments")).otherwise(F.array().cast("array<string>")).alias("invalid_examples"),
    )


def flat_profile(profile: DataFrame) -> DataFrame:
    """Lists as text: ``v=n; v=n`` and examples joined by a bar."""
    tops = F.transform("top_values", lambda s: F.concat(s["value"], F.lit("="), s["n"].cast("string")))
    out = profile.withColumn("top_values", F.array_join(tops, "; "))
    for c in ("unique_ratio", "numeric_parse_rate", "datetime_parse_rate"):
        out = out.withColumn(c, float_text(F.col(c)))
    return out.withColumn("invalid_examples", F.array_join("invalid_examples", "|"))
