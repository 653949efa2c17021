"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by their exact spelling.

    Other columns go, whatever their names: ``Text`` beside ``text``, or two
    columns of one name (the first counts), don't make a reference ambiguous.
    """
    at = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return at.select(*(F.col(f"_c{df.columns.index(n)}").alias(n) for n in names))


def remainder(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where the session has none and all is one local process is one made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined() and (not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = own.get() if own.isDefined() else tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spool(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files and nothing
    that was computed before.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}-{name}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the JVM has gone first
            pass

    atexit.register(drop)
    return path


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for ``rows``, at least as many as shuffles have by default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part))


def count_words(text: Column) -> Column:
    """How many words; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class Bounded(dict):
    """A dict that makes missing values and holds 2 * ``most`` keys at most.

    When ``most`` keys are in, they become the older half and what it held goes;
    a key that is asked for comes back from there.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def as_text(values: Sequence) -> list[str]:
    """Strings of a pandas column; nulls become empty."""
    return [v if isinstance(v, str) else "" for v in values]
