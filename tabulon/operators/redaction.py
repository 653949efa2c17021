"""Masking or hashing of sensitive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, col

MASK = "[redacted]"
#: Fields of a profile that show values of the profiled column, and fields of
#: other sections that show values of any column.
SHOWN, RAW = ("top_values", "invalid_examples", "min_value", "max_value"), ("left_value", "right_values", "value", "column_scores")


def hidden(value: Column, mode: str) -> Column:
    new = F.lit(MASK) if mode == "mask" else F.substring(F.sha2(value, 256), 1, 16)
    return F.when(value == "", "").otherwise(new)


def redact(df: DataFrame, columns: list[str], mode: str = "mask", strict: bool = False) -> DataFrame:
    """``df`` with the columns' filled values hidden.

    In a profile, the rows of those columns lose the values that they show; with
    ``strict`` also raw values that other sections carry under other names.
    """
    if not columns:
        return df
    if mode not in ("mask", "hash"):
        raise ValueError("redaction mode must be mask or hash")
    out = {c: hidden(as_text(df, c), mode) for c in df.columns if c in columns or (strict and c in RAW)}
    if "column" in df.columns:
        named = col("column").isin(*columns)
        for c in SHOWN:
            if c in df.columns and c not in out:
                value = as_text(df, c)
                out[c] = F.when(named & (value != ""), MASK).otherwise(value)
    return df.withColumns(out)
