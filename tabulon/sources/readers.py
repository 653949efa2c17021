"""Tables from files and memory, as DataFrames of text."""

from __future__ import annotations

import codecs
import itertools
import json
import tomllib
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_text

# Which suffix means which format.
SUFFIXES = {
    "csv": [".csv"], "tsv": [".tsv", ".tab"], "xlsx": [".xlsx", ".xls"], "parquet": [".parquet", ".pq"],
}
POSITION = "_pos"


def resolve_format(path: str, format: str | None = None) -> str:
    """An explicit format, or the one that the suffix means."""
    if format and format != "auto":
        return format
    suffix = Path(path).suffix.lower()
    for name, suffixes in SUFFIXES.items():
        if suffix in suffixes:
            return name
    raise ValueError(f"Could not infer input format from {path}; pass a format.")


def resolve_delimiter(format: str, delimiter: str = ",") -> str:
    return "\t" if format == "tsv" else delimiter


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required column(s): {', '.join(missing)}")


def charset(spark: SparkSession, encoding: str) -> str:
    """Spark's name of an encoding that Python knows.

    Beyond its short list Spark takes any name that Java knows, if the session says so.
    """
    try:
        name = codecs.lookup(encoding).name
    except LookupError as e:
        raise ValueError(f"Unknown encoding: {encoding}") from e
    name = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii", "utf-8-sig": "utf-8"}.get(name, name.replace("_", "-"))
    if not name.startswith(("iso-8859-1", "us-ascii", "utf-")):
        spark.conf.set("spark.sql.legacy.javaCharsets", True)
    return name


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",", multiline: bool = True) -> DataFrame:
    """Header required, values untouched; short rows are filled with empty text.

    With ``multiline`` a cell may hold line breaks and a file is read by one
    task; without it files are split, which large inputs need.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multiline)
    df = reader.option("quote", '"').option("escape", '"').option("encoding", charset(spark, encoding)).option("sep", delimiter).csv(path)
    return df.fillna("")


def read_excel(spark: SparkSession, path: str, sheet_name: str | int = 0) -> DataFrame:
    try:
        import pandas as pd

        return from_pandas(spark, pd.read_excel(path, sheet_name=sheet_name))
    except ImportError as e:
        raise RuntimeError("Excel input needs pandas and openpyxl.") from e


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A pandas DataFrame, its labels and values as text."""
    if not hasattr(frame, "to_dict"):
        raise TypeError("Expected a DataFrame.")
    names = [str(c) for c in frame.columns]
    rows = [tuple("" if v is None or v != v else str(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def read_table(spark: SparkSession, path: str, format: str | None = None, encoding: str = "utf-8", delimiter: str = ",", sheet_name: str | int = 0, multiline: bool = True) -> DataFrame:
    """Any supported file; Parquet keeps its types until a column is used.

    ``multiline=False`` lets large CSV files be split, where no cell holds a line break.
    """
    kind = resolve_format(path, format)
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, encoding, resolve_delimiter(kind, delimiter), multiline)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        return read_excel(spark, path, sheet_name)
    raise ValueError(f"Unsupported input format: {kind}")


def normalize(df: DataFrame) -> DataFrame:
    """All columns as text, null as empty."""
    return df.select(*(as_text(df, c).alias(c) for c in df.columns))


def with_position(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Adds the order of rows: of ``order_by``, or else as they are read."""
    if POSITION in df.columns:
        return df
    place = F.col(f"`{order_by}`") if order_by else F.monotonically_increasing_id()
    return df.withColumn(POSITION, place)


def iter_rows(df: DataFrame) -> Iterator[dict]:
    """Rows as dicts, a partition at a time."""
    return (r.asDict() for r in df.toLocalIterator(prefetchPartitions=True))


def chunks(rows: Iterable, size: int) -> Iterator[list]:
    if size < 1:
        raise ValueError("chunk_size must be >= 1")
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield part


def scan_csv(spark: SparkSession, path: str, size: int, encoding: str = "utf-8", delimiter: str = ",", multiline: bool = True) -> Iterator[list[dict]]:
    """Rows of a CSV file in lists of at most ``size``; the driver holds one partition at a time."""
    return chunks(iter_rows(read_csv(spark, path, encoding, delimiter, multiline)), size)


def load_recipe(path: str) -> dict:
    suffix = Path(path).suffix.lower()
    if suffix == ".json":
        return json.loads(Path(path).read_text(encoding="utf-8"))
    if suffix in (".toml", ".tml"):
        return tomllib.loads(Path(path).read_text(encoding="utf-8"))
    raise ValueError("Report config must be JSON or TOML.")
