"""Structure of CSV files, byte by byte: one task a file, many files at once.

A quoted cell may hold a line break, so a file can't be split without being read
from its start.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ISSUE = "path string, encoding string, header_columns long, data_rows long, issue_type string, line_number long, message string"


def examine(content: bytes, encoding: str = "utf-8", delimiter: str = ",") -> tuple[int, int, list[tuple[str, int, str]]]:
    """(columns of the header, data rows, issues): NULs, then encoding, then structure."""
    issues = []
    if nul := content.count(b"\0"):
        issues.append(("nul_byte", 0, f"File contains {nul} NUL byte(s)."))
    try:
        text = content.decode(encoding)
    except UnicodeDecodeError as e:
        issues.append(("encoding", e.start, str(e)))
        text = content.decode(encoding, errors="replace")
    header, rows, found = 0, 0, []
    try:
        for number, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), start=1):
            if number == 1:
                header = len(cells)
                continue
            rows += 1
            if len(cells) != header:
                found.append(("column_count", number, f"Expected {header} column(s), found {len(cells)}."))
            found += [("embedded_newline", number, "Cell contains a line break.") for c in cells if "\n" in c or "\r" in c]
    except csv.Error as e:
        header, rows, found = 0, 0, [("csv_parse", 0, str(e))]
    return header, rows, issues + found


def analyze_contents(files: DataFrame, encoding: str = "utf-8", delimiter: str = ",") -> DataFrame:
    """A row for each issue of each (path, content); ``ok`` for a clean one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                header, rows, issues = examine(content, encoding, delimiter)
                out += [(name, encoding, header, rows, *i) for i in issues or [("ok", 0, "")]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ISSUE.split(", ")])

    return files.select("path", "content").mapInPandas(run, ISSUE)


def analyze(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",") -> DataFrame:
    """A row for each issue of each file under ``path``."""
    return analyze_contents(spark.read.format("binaryFile").load(path), encoding, delimiter)


def report(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",") -> dict:
    """One file's findings as a dict with ``ok`` and its issues."""
    rows = analyze(spark, path, encoding, delimiter).collect()
    issues = [{k: r[k] for k in ("issue_type", "line_number", "message")} for r in rows if r["issue_type"] != "ok"]
    return {"path": path, "encoding": encoding, "header_columns": rows[0]["header_columns"], "data_rows": rows[0]["data_rows"], "ok": not issues, "issues": issues}


def strip_nul_bytes(path: str, out: str) -> int:
    """Copy a file without its NUL bytes; how many there were."""
    removed = 0
    with open(path, "rb") as source, open(out, "wb") as target:
        while block := source.read(1 << 20):
            removed += block.count(b"\0")
            target.write(block.replace(b"\0", b""))
    return removed
