"""Command line: ten verbs. Exit 0: nothing found, 1: findings, 2: an error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..operators import clusters, compare, duplicates, lookup, mappings, pairs, profile, redaction, similarity
from ..sources import hygiene, writers
from ..sources.readers import read_table
from .report import as_list, build_report, cluster_chart

FORMATS = ["auto", "csv", "tsv", "xlsx", "parquet"]
SCORERS = ["auto", "difflib", "rapidfuzz", "jaccard", "levenshtein"]
NORMALIZATIONS = ["basic", "none"]


def readable(p: argparse.ArgumentParser, side: str = "", formats: bool = True, short: bool = True) -> None:
    """Options that say how to read an input; ``side`` is their prefix where there are two."""
    dash = f"--{side}-" if side else "--"
    p.add_argument(f"{dash}encoding", default="utf-8")
    p.add_argument(f"{dash}delimiter", default=",")
    if formats:
        p.add_argument(f"{dash}format", choices=FORMATS, default="auto")
        p.add_argument(f"{dash}sheet-name", default=0)
    if short:
        p.add_argument("--single-line", action="store_true", help="no cell holds a line break, so files may be split")


def duplicate_options(p: argparse.ArgumentParser, prefix: str) -> None:
    p.add_argument(f"--{prefix}max-block-size", type=int)
    p.add_argument(f"--{prefix}oversized-block-behavior", choices=duplicates.BEHAVIOURS, default="fail" if not prefix else None)
    p.add_argument(f"--{prefix}sample-rate", type=float, default=1.0 if not prefix else None)
    p.add_argument(f"--{prefix}workers", type=int, default=1 if not prefix else None)


def redactable(p: argparse.ArgumentParser, default: str | None) -> None:
    p.add_argument("--redact", action="append")
    p.add_argument("--redact-mode", choices=["mask", "hash"], default=default)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabulon")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *inputs: str, reads: bool = True, formats: bool = True) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for i in inputs:
            v.add_argument(i)
        v.add_argument("--out")
        if reads:
            readable(v, formats=formats, short=formats)
        return v

    verb("hygiene", "input", formats=False)
    verb("profile", "input")
    v = verb("pair-profile", "input")
    v.add_argument("--threshold", type=float, default=0.5), v.add_argument("--identical-out")
    v = verb("mappings", "input")
    v.add_argument("--left", required=True), v.add_argument("--right", required=True), v.add_argument("--keep-blank", action="store_true")
    v = verb("compare", "old", "new", reads=False)
    readable(v, "old"), readable(v, "new", short=False)
    v.add_argument("--id", required=True), v.add_argument("--member", required=True), v.add_argument("--narrative", action="store_true")
    v = verb("duplicates", "input")
    v.add_argument("--block", required=True), v.add_argument("--match", action="append", required=True), v.add_argument("--id")
    v.add_argument("--threshold", type=float, default=0.85), v.add_argument("--scorer", choices=SCORERS, default="auto")
    v.add_argument("--normalization", choices=NORMALIZATIONS, default="basic")
    duplicate_options(v, "")
    v = verb("clusters", "input")
    v.add_argument("--cluster", required=True), v.add_argument("--match-column", action="append"), v.add_argument("--match-prefix")
    v.add_argument("--large-cluster-size", type=int, default=10), v.add_argument("--low-match-score", type=float, default=0.85), v.add_argument("--chart-out")
    v = verb("similarity", "details", "pairs", reads=False)
    readable(v, "details", formats=False), readable(v, "pairs", formats=False, short=False)
    v.add_argument("--cluster", required=True), v.add_argument("--left-pair", default="left_entity_id"), v.add_argument("--right-pair", default="right_entity_id")
    v.add_argument("--compare", action="append", required=True), v.add_argument("--method", choices=["jaccard", "tfidf"], default="jaccard")
    v.add_argument("--review-threshold", type=float, default=0.65), v.add_argument("--likely-match-threshold", type=float, default=0.85)
    # A report takes what is not given from its recipe, so its options have no defaults here.
    v = verbs.add_parser("report")
    v.add_argument("input", nargs="?")
    for a in ("config", "out-dir", "workbook-out", "pdf-out", "title", "encoding", "delimiter", "sheet-name", "cluster", "match-prefix", "duplicate-block", "duplicate-id"):
        v.add_argument(f"--{a}")
    for a in ("mapping", "match-column", "duplicate-match"):
        v.add_argument(f"--{a}", action="append", dest="mappings" if a == "mapping" else None)
    for a in ("large-cluster-size", "max-output-rows"):
        v.add_argument(f"--{a}", type=int)
    for a in ("low-match-score", "duplicate-threshold"):
        v.add_argument(f"--{a}", type=float)
    v.add_argument("--format", choices=FORMATS), v.add_argument("--duplicate-scorer", choices=SCORERS), v.add_argument("--normalization", choices=NORMALIZATIONS)
    duplicate_options(v, "duplicate-"), redactable(v, None)
    for a in ("redact-strict", "single-line"):
        v.add_argument(f"--{a}", action="store_true", default=None)
    v = verb("lookup", "input")
    v.add_argument("--id", required=True), v.add_argument("--value", required=True), v.add_argument("--cluster")
    redactable(v, "mask")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    def table(path: str, side: str = "", format: str | None = None) -> DataFrame:
        of = lambda name, default=None: getattr(a, side + name, default)
        return read_table(spark, path, format or of("format"), of("encoding"), of("delimiter"), of("sheet_name", 0), not a.single_line)

    def put(df: DataFrame) -> int:
        return writers.write_csv(df, a.out)

    if a.verb == "report":
        given = {k: v for k, v in vars(a).items() if k not in ("verb", "config")}
        print(build_report(spark, a.config, **given))
        return 0
    if a.verb == "hygiene":
        rows = hygiene.analyze(spark, a.input, a.encoding, a.delimiter).cache()
        put(rows.select("path", "issue_type", "line_number", "message"))
        return int(not rows.filter("issue_type <> 'ok'").isEmpty())
    if a.verb == "profile":
        put(profile.flat_profile(profile.profile_columns(table(a.input))))
        return 0
    if a.verb == "pair-profile":
        df = table(a.input)
        if a.identical_out:
            writers.write_csv(pairs.find_identical_column_pairs(df), a.identical_out)
        put(pairs.find_grouping_candidates(df, a.threshold))
        return 0
    if a.verb == "mappings":
        return int(put(mappings.flat_mappings(mappings.find_one_to_many_mappings(table(a.input), a.left, a.right, not a.keep_blank))) > 0)
    if a.verb == "compare":
        return int(put(compare.flat_differences(compare.compare_export_membership(table(a.old, "old_"), table(a.new, "new_"), a.id, a.member, a.narrative))) > 0)
    if a.verb == "duplicates":
        found = duplicates.find_duplicate_candidates(
            table(a.input), a.block, as_list(a.match), a.id, a.threshold, a.scorer, a.normalization, a.max_block_size, a.sample_rate, a.oversized_block_behavior, a.workers
        )
        return int(put(duplicates.flat_duplicates(found)) > 0)
    if a.verb == "clusters":
        summary = clusters.summarize_clusters(table(a.input), a.cluster, as_list(a.match_column), a.match_prefix, a.large_cluster_size, a.low_match_score)
        if a.chart_out:
            cluster_chart(summary, a.chart_out)
        put(clusters.flat_clusters(summary))
        return 0
    if a.verb == "similarity":
        details, listed = table(a.details, "details_", "csv"), table(a.pairs, "pairs_", "csv")
        scored = similarity.compare_cluster_pairs(details, listed, a.cluster, a.left_pair, a.right_pair, as_list(a.compare), a.method, a.review_threshold, a.likely_match_threshold)
        put(similarity.flat_similarity(scored))
        return 0
    found = lookup.lookup_entity(table(a.input), a.id, a.value, a.cluster)
    hide = as_list(a.redact)
    if a.cluster in hide:
        hide.append("_lookup_cluster")  # the same value under another name
    return int(put(redaction.redact(found, hide, a.redact_mode)) == 0)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tabulon").getOrCreate()
    try:
        return run(spark, a)
    except (RuntimeError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
