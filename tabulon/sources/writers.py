"""Results as CSV, HTML, SVG, workbooks and PDF, written by the driver.

Previews and sheets have caps; section CSVs hold all rows, streamed a partition at
a time. ``write_csv_folder`` is the way for results too large for that.
"""

from __future__ import annotations

import csv
import html
import re
import sys
from collections.abc import Callable, Iterable
from contextlib import nullcontext
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


@dataclass
class Section:
    title: str
    rows: DataFrame
    csv_name: str
    summary: str = ""


def flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, the rest as they are."""
    simple = {n for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))}
    return df.select(*(F.col(f"`{c}`") if c in simple else F.to_json(F.col(f"`{c}`")).alias(c) for c in df.columns))


def write_rows(rows: Iterable[dict], path: str | None) -> None:
    """A CSV file, or standard output; fields in the order in which they are first seen.

    For rows already on the driver; ``write_csv`` streams those of a DataFrame.
    """
    rows = list(rows)
    names = list(dict.fromkeys(k for r in rows for k in r))
    if path is None:
        if rows:
            out = csv.DictWriter(sys.stdout, names, lineterminator="\n")
            out.writeheader()
            out.writerows(rows)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, names, restval="")
        out.writeheader()
        out.writerows(rows)


def cell(value) -> str:
    return "" if value is None else str(value)


def write_csv(df: DataFrame, path: str | None = None, each: Callable[[Row], None] | None = None) -> int:
    """All rows of a DataFrame into one CSV, or to standard output, where no rows print nothing; how many.

    The driver holds one partition at a time; ``each`` sees every row on its way.
    """
    df, n = flat(df), 0
    if path is not None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    with nullcontext(sys.stdout) if path is None else open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n" if path is None else "\r\n")
        if path is not None:
            out.writerow(df.columns)
        for row in df.toLocalIterator(prefetchPartitions=True):
            if path is None and n == 0:
                out.writerow(df.columns)
            out.writerow([cell(v) for v in row])
            n += 1
            if each:
                each(row)
    return n


def write_csv_folder(df: DataFrame, path: str) -> None:
    """As many files as there are partitions, by the executors."""
    flat(df).write.option("header", True).csv(path)


def html_report(sections: list[Section], folder: str, title: str = "Review report", preview: int | None = None) -> str:
    """report.html with previews, and a CSV of each section in full, in one pass over its rows."""
    if preview is not None and preview < 0:
        raise ValueError("preview row cap must be >= 0")
    path = Path(folder, "report.html")
    path.parent.mkdir(parents=True, exist_ok=True)
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(cell(v))}</{tag}>" for v in values)
    with open(path, "w", encoding="utf-8") as page:
        page.write(f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>')
        for s in sections:
            link = html.escape(s.csv_name)
            page.write(f'<h2>{html.escape(s.title)}</h2><p>{html.escape(s.summary)}</p><p><a href="{link}">{link}</a></p>')
            shown = 0

            def show(row: Row) -> None:
                nonlocal shown
                if preview is None or shown < preview:
                    page.write(("" if shown else f"<table><tr>{cells('th', row.asDict())}</tr>") + f"<tr>{cells('td', row)}</tr>")
                    shown += 1

            total = write_csv(s.rows, str(Path(folder, s.csv_name)), show)
            page.write("</table>" if shown else "" if total else "<p>No rows</p>")
            page.write(f"<p>Showing first {shown} of {total} row(s)</p>" if shown < total else "")
        page.write("</body></html>")
    return str(path)


def sheet_name(title: str, taken: set[str]) -> str:
    """At most 31 characters, none that workbooks forbid, unlike those taken."""
    base = re.sub(r"\s+", " ", re.sub(r"[\[\]:*?/\\]", "_", title)).strip()[:31] or "Section"
    name, k = base, 2
    while name.lower() in {t.lower() for t in taken}:
        tail = f" {k}"
        name, k = base[: 31 - len(tail)] + tail, k + 1
    taken.add(name)
    return name


def workbook(sections: list[Section], path: str, cap: int | None = None) -> str:
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("Workbook output needs openpyxl.") from e
    book, taken = Workbook(), {"Summary"}
    top = book.active
    top.title = "Summary"
    top.append(["Section", "Rows", "Summary", "Exported Rows", "Capped"] if cap is not None else ["Section", "Rows", "Summary"])
    for s in sections:
        sheet, total, kept = book.create_sheet(sheet_name(s.title, taken)), 0, 0
        for row in flat(s.rows).toLocalIterator(prefetchPartitions=True):
            total += 1
            if cap is None or kept < cap:
                if not kept:
                    sheet.append(s.rows.columns)
                sheet.append(list(row))
                kept += 1
        if kept:
            sheet.freeze_panes, sheet.auto_filter.ref = "A2", sheet.dimensions
        else:
            sheet.append(["No rows"])
        top.append([s.title, total, s.summary, *([kept, "yes" if kept < total else "no"] if cap is not None else [])])
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    book.save(path)
    return path


def pdf_report(html_path: str, path: str) -> str:
    try:
        from weasyprint import HTML
    except ImportError as e:
        raise RuntimeError("PDF output needs WeasyPrint.") from e
    HTML(html_path).write_pdf(path)
    return path


def bar_chart(labels: list[str], values: list[float], title: str, width: int = 640) -> str:
    """Horizontal bars as SVG, scaled to the greatest value."""
    most, out = max([*values, 1e-12]), []
    for i, (label, value) in enumerate(zip(labels, values, strict=True)):
        y, w = 40 + 24 * i, max(0.0, value / most) * (width - 260)
        out.append(f'<text x="8" y="{y + 14}">{html.escape(label)}</text><rect x="180" y="{y}" width="{w:.1f}" height="18" fill="#4477aa"/><text x="{186 + w:.1f}" y="{y + 14}">{value:g}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{56 + 24 * len(labels)}" font-family="sans-serif" font-size="12"><text x="8" y="20" font-size="15">{html.escape(title)}</text>{"".join(out)}</svg>'


def histogram_chart(bins: DataFrame, title: str, mean: float | None = None) -> str:
    """Bars of a histogram; labels in percent where all values are in [0, 1]."""
    rows = bins.orderBy("bin").collect()
    unit = bool(rows) and rows[0]["low"] >= 0 and rows[-1]["high"] <= 1
    text = (lambda x: f"{100 * x:.0f}%") if unit else (lambda x: f"{x:.4g}")
    labels = [text(r["low"]) if r["low"] == r["high"] else f"{text(r['low'])}-{text(r['high'])}" for r in rows]
    total = sum(r["n"] for r in rows)
    return bar_chart(labels, [r["n"] for r in rows], f"{title} (n={total}" + (f", mean={mean:.4g})" if mean is not None else ")"))
