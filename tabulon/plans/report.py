"""A review report: sections over one read of the input, redacted, then written."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, duplicates, mappings, profile, redaction
from ..operators.histogram import score_histogram
from ..sources import hygiene, writers
from ..sources.readers import load_recipe, read_table, resolve_delimiter, resolve_format, with_position

DEFAULTS = {
    "format": None, "encoding": "utf-8", "delimiter": ",", "sheet_name": 0, "title": "Review report", "normalization": "basic",
    "duplicate_threshold": 0.85, "duplicate_scorer": "auto", "large_cluster_size": 10, "low_match_score": 0.85, "redact_mode": "mask",
    "duplicate_sample_rate": 1.0, "duplicate_oversized_block_behavior": "fail", "duplicate_workers": 1,
}
#: Bars of a chart of clusters; the table beside it has them all.
BARS = 100


def setting(name: str, given: dict, recipe: dict, required: bool = False):
    """What was given, else the recipe's, else the default."""
    for source in (given, recipe, DEFAULTS):
        if source.get(name) not in (None, [], ""):
            return source[name]
    if required:
        raise ValueError(f"Missing required setting: {name}")
    return None


def as_list(value) -> list[str]:
    if value is None:
        return []
    parts = value if isinstance(value, list) else [value]
    return [x.strip() for p in parts for x in str(p).split(",") if x.strip()]


def mapping_specs(value) -> list[tuple[str, str]]:
    out = []
    for spec in value or []:
        if isinstance(spec, dict):
            out.append((spec["left"], spec["right"]))
        elif ":" in spec:
            out.append(tuple(spec.split(":", 1)))
        else:
            raise ValueError(f"Mapping must be LEFT:RIGHT, not {spec}")
    return out


def safe_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def cluster_chart(summary: DataFrame, path: str) -> None:
    """Bars of the largest clusters, from a summary or its redacted form."""
    top = summary.limit(BARS).collect()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(writers.bar_chart([r["cluster_id"] for r in top], [r["size"] for r in top], "Cluster sizes"), encoding="utf-8")


def build_report(spark: SparkSession, recipe_path: str | None = None, **given) -> str:
    """Write all sections and return the path of the HTML."""
    recipe = load_recipe(recipe_path) if recipe_path else {}
    dup = recipe.pop("duplicates", {}) if isinstance(recipe.get("duplicates"), dict) else {}
    recipe |= {k if k == "normalization" else f"duplicate_{k}": v for k, v in dup.items()}
    if "mapping" in recipe:
        recipe["mappings"] = recipe.pop("mapping")
    get = lambda name, required=False: setting(name, given, recipe, required)
    path, folder = get("input", True), get("out_dir", True)
    kind = resolve_format(path, get("format"))
    delimiter = resolve_delimiter(kind, get("delimiter"))
    data = with_position(read_table(spark, path, kind, get("encoding"), delimiter, get("sheet_name"), not get("single_line"))).cache()
    sections: list[writers.Section] = []
    charts: dict[str, DataFrame] = {}
    if kind in ("csv", "tsv"):
        sections.append(writers.Section("CSV hygiene", hygiene.analyze(spark, path, get("encoding"), delimiter), "hygiene.csv"))
    else:
        skipped = spark.createDataFrame([("csv_hygiene", "skipped", "Only CSV and TSV files have bytes and rows to check.")], "check string, status string, detail string")
        sections.append(writers.Section("Input hygiene", skipped, "hygiene.csv"))
    sections.append(writers.Section("Column profile", profile.flat_profile(profile.profile_columns(data)), "profile.csv"))
    for left, right in mapping_specs(get("mappings")):
        found = mappings.flat_mappings(mappings.find_one_to_many_mappings(data, left, right))
        sections.append(writers.Section(f"Mapping {left} to {right}", found, f"mapping_{safe_name(left)}_to_{safe_name(right)}.csv"))
    if cluster := get("cluster"):
        args = (cluster, as_list(get("match_column") or get("match_columns")), get("match_prefix"), get("large_cluster_size"), get("low_match_score"))
        summary = clusters.summarize_clusters(data, *args)
        sections.append(writers.Section("Clusters", clusters.flat_clusters(summary), "clusters.csv"))
        charts["match_score_distribution"] = summary
    if block := get("duplicate_block"):
        found = duplicates.find_duplicate_candidates(
            data, block, as_list(get("duplicate_match")), get("duplicate_id"), float(get("duplicate_threshold")), get("duplicate_scorer"), get("normalization"),
            get("duplicate_max_block_size"), float(get("duplicate_sample_rate")), get("duplicate_oversized_block_behavior"), int(get("duplicate_workers")),
        )
        sections.append(writers.Section("Duplicate candidates", duplicates.flat_duplicates(found), "duplicate_candidates.csv"))
    hide, mode, strict = as_list(get("redact")), get("redact_mode"), bool(get("redact_strict"))
    for s in sections:
        s.rows = redaction.redact(s.rows, hide, mode, strict)
    for name, summary in charts.items():  # after redaction, so that no hidden id is drawn
        Path(folder).mkdir(parents=True, exist_ok=True)
        shown = redaction.redact(summary.withColumnRenamed("cluster_id", cluster), hide, mode).withColumnRenamed(cluster, "cluster_id")
        cluster_chart(shown, str(Path(folder, "cluster_sizes.svg")))
        mean = summary.agg(F.avg("average_match_score")).first()[0]
        if mean is not None:
            Path(folder, f"{name}.svg").write_text(writers.histogram_chart(score_histogram(summary, "average_match_score"), "Average match score distribution", mean), encoding="utf-8")
    most = get("max_output_rows")
    most = None if most is None else int(most)
    out = writers.html_report(sections, folder, get("title"), most)
    if get("workbook_out"):
        writers.workbook(sections, get("workbook_out"), most)
    if get("pdf_out"):
        writers.pdf_report(out, get("pdf_out"))
    data.unpersist()
    return out
