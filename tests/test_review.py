import csv
import difflib
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions import text as T
from tabulon.operators import clusters, compare, duplicates, histogram, lookup, mappings, pairs, profile, redaction, review, similarity
from tabulon.plans import api, cli, report
from tabulon.sources import hygiene, readers, writers


def frame(spark, columns, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in columns) + ", _pos long")


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1)
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_strip_matches_python(spark):
    samples = ["\t a ", " b　", "c", "", "\x1c d \x1f", "​e"]
    assert one(spark, T.strip, *samples) == [s.strip() for s in samples]


def test_numbers(spark):
    got = one(spark, T.number_of, "$1,250.50", "(3)", "12%", "1_000", "1d", "0x1p3", "abc", "1e3", " 7 ", "inf")
    assert got == [1250.5, -3.0, 12.0, 1000.0, None, None, None, 1000.0, 7.0, float("inf")]


def test_moments(spark):
    day = lambda c: F.date_format(T.moment_of(c), "yyyy-MM-dd HH:mm")
    got = one(spark, day, "2026-01-31", "01/31/2026", "1/2/69", "2026/1/2", "2026-02-30", "2026", "12:30", "20260131", "2026-01-02T03:04:05Z", "2026-W01-1")
    assert got == ["2026-01-31 00:00", "2026-01-31 00:00", "1969-01-02 00:00", "2026-01-02 00:00", None, None, None, "2026-01-31 00:00", "2026-01-02 03:04", "2025-12-29 00:00"]


def test_float_text_matches_python(spark):
    values = [1e7, 0.0001, 12345678.9, 1e16, 1e-5, 10.5, -2.0, 123456789012345.6]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    assert [r[0] for r in df.select(T.float_text(F.col("x"))).collect()] == [str(v) for v in values]


def test_fold_matches_casefold_on_tokens(spark):
    words = ["Straße", "ﬁne", "ſtop", "K", "ÀB", "MiXed"]
    got = one(spark, lambda c: T.normalized(c, "basic"), *words)
    import re

    assert got == [" ".join(re.findall("[A-Za-z0-9]+", w.casefold())) for w in words]


def test_mappings(spark):
    df = frame(spark, ["l", "r"], ("A", "2"), ("A", "1"), ("B", "3"), (" A ", "1"), ("", "9"), ("", "8"))
    rows = mappings.find_one_to_many_mappings(df, "l", "r").collect()
    assert [tuple(r) for r in rows] == [("A", 2, ["1", "2"])]
    assert mappings.find_one_to_many_mappings(df, "l", "r", ignore_blank=False).count() == 2
    with pytest.raises(ValueError, match=r"Missing required column\(s\): x"):
        mappings.find_one_to_many_mappings(df, "x", "r")


def test_clusters(spark):
    df = frame(spark, ["c", "match_score"], ("c1", "0.9"), ("c1", "0.7"), ("c2", "not-a-number"))
    rows = {r["cluster_id"]: r for r in clusters.summarize_clusters(df, "c", match_prefix="match").collect()}
    assert rows["c1"]["average_match_score"] == pytest.approx(0.8) and rows["c1"]["outlier_reason"] == "low_match_score"
    assert rows["c2"]["average_match_score"] is None and rows["c2"]["outlier_score"] == 0.0
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 5, 6, 10, 11, 25, 26, 50, 51, 100, 101, 250, 251, 500, 501)], "n long").coalesce(1)
    got = [r[0] for r in sizes.select(clusters.size_bucket(F.col("n"))).collect()]
    assert got == ["1", "2-5", "2-5", "6-10", "6-10", "11-25", "11-25", "26-50", "26-50", "51-100", "51-100", "101-250", "101-250", "251-500", "251-500", "500+"]


def test_profile(spark):
    df = frame(spark, ["account_id", "balance", "day", "status"], ("1", "$500", "2026-01-31", "a"), ("2", "1,000.33", "03/31/2026", "a"), ("3", "3000", "2026/2/1", "b"), ("4", "not available", "2026-02-28", "b"))
    got = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert got["account_id"]["inferred_type"] == "identifier" and got["status"]["inferred_type"] == "categorical"
    b = got["balance"]
    assert (b["inferred_type"], b["numeric_parse_rate"], b["min_value"], b["median"], b["max_value"]) == ("currency", 0.75, "500", "1000.33", "3000")
    assert b["invalid_examples"] == ["not available"]
    assert (got["day"]["inferred_type"], got["day"]["min_value"], got["day"]["max_value"]) == ("datetime", "2026-01-31", "2026-03-31")
    assert [tuple(t) for t in got["status"]["top_values"]] == [("a", 2), ("b", 2)]
    empty = profile.profile_columns(frame(spark, ["x"], ("",), ("n/a",))).first()
    assert empty["inferred_type"] == "empty" and empty["null_like_count"] == 2 and empty["unique_count"] == 2


def test_pairs(spark):
    df = frame(spark, ["left", "right", "different"], ("a", "a", "x"), ("b", "b", "b"), ("", "", ""))
    assert [tuple(r) for r in pairs.find_identical_column_pairs(df).collect()] == [("left", "right", 3)]
    df = frame(spark, ["brand", "sku"], ("Acme", "1"), ("Acme", "2"), ("Other", "3"), ("Other", "4"))
    assert [tuple(r) for r in pairs.find_grouping_candidates(df).collect()] == [("brand", "Acme", 2, 4, 0.5)]


def test_compare(spark):
    old = frame(spark, ["g", "m"], ("g1", "a"), ("g1", "b"), ("g2", "c"))
    new = frame(spark, ["g", "m"], ("g3", "a"), ("g4", "b"), ("g4", "c"))
    rows = [tuple(r) for r in compare.compare_export_membership(old, new, "g", "m", include_narratives=True).collect()]
    assert rows[:4] == [("g1", "removed", ["a", "b"], []), ("g2", "removed", ["c"], []), ("g3", "added", [], ["a"]), ("g4", "added", [], ["b", "c"])]
    assert ("a", "member_reassigned", ["g1"], ["g3"]) in rows
    assert ("g1", "split", ["a", "b"], ["g3", "g4"]) in rows and rows[-1] == ("g4", "merged", ["g1", "g2"], ["b", "c"])
    same = frame(spark, ["g", "m"], ("g1", "a"), ("g1", "x"), ("g2", "c"))
    assert [tuple(r) for r in compare.compare_export_membership(old, same, "g", "m").collect()] == [("g1", "members_changed", ["a", "b"], ["a", "x"])]


def test_lookup(spark):
    df = frame(spark, ["id", "c"], ("e1", "p1"), ("e2", "p1"), ("e3", "p2"), ("e1", "p2"))
    rows = [tuple(r) for r in lookup.lookup_entity(df, "id", "e1", "c").collect()]
    assert rows == [("e1", "p1", "match", "p1"), ("e2", "p1", "cluster_sibling", "p1"), ("e1", "p2", "match", "p1")]
    assert lookup.lookup_entity(df, "id", "none", "c").count() == 0


def test_similarity(spark):
    details = frame(spark, ["c", "name"], ("p1", "Acme, Corp"), ("p2", "ACME Corporation"), ("p3", ""))
    listed = frame(spark, ["l", "r"], ("p1", "p2"), ("p1", "p3"), ("u", "v"))
    got = {(r[0], r[1]): (round(r[2], 4), r[3]) for r in similarity.compare_cluster_pairs(details, listed, "c", "l", "r", ["name"]).collect()}
    assert got == {("p1", "p2"): (0.3333, "low_similarity"), ("p1", "p3"): (0.0, "low_similarity"), ("u", "v"): (1.0, "likely_match")}
    assert {r[2] for r in similarity.compare_cluster_pairs(details, listed.limit(0), "c", "l", "r", ["name"], "tfidf").collect()} == set()
    with pytest.raises(ValueError):
        similarity.compare_cluster_pairs(details, listed, "c", "l", "r", ["name"], review_threshold=0.9, likely_match_threshold=0.7)


def test_duplicates(spark):
    people = frame(spark, ["dob", "name", "id"], ("1", "Jon Smith", "t1"), ("1", "John Smith", "t2"), ("2", "Ana Lopez", "t3"), ("2", "Lopez Anna", "t4"), ("", "x", "t5"))
    rows = duplicates.find_duplicate_candidates(people, "dob", ["name"], "id", 0.8, "difflib").collect()
    for r in rows:
        names = {"t1": "jon smith", "t2": "john smith", "t3": "ana lopez", "t4": "lopez anna"}
        a, b = (" ".join(sorted(names[r[c]].split())) for c in ("left_id", "right_id"))
        assert r["score"] == difflib.SequenceMatcher(None, a, b).ratio()
    assert [(r["left_id"], r["right_id"]) for r in rows] == [("t1", "t2"), ("t3", "t4")] or len(rows) == 2
    block = frame(spark, ["b", "n"], *[("k", "same")] * 6)
    with pytest.raises(duplicates.DuplicateBlockSizeError):
        duplicates.find_duplicate_candidates(block, "b", ["n"], max_block_size=3)
    with pytest.warns(RuntimeWarning):
        assert duplicates.find_duplicate_candidates(block, "b", ["n"], max_block_size=3, oversized_block_behavior="warn").count() == 15
    with pytest.warns(RuntimeWarning):
        assert duplicates.find_duplicate_candidates(block, "b", ["n"], max_block_size=3, oversized_block_behavior="sample").count() == 3
    some = [tuple(r)[:3] for r in duplicates.find_duplicate_candidates(block, "b", ["n"], sample_rate=0.4).collect()]
    assert 0 < len(some) < 15 and some == [tuple(r)[:3] for r in duplicates.find_duplicate_candidates(block, "b", ["n"], sample_rate=0.4).collect()]
    assert duplicates.find_duplicate_candidates(block, "b", ["n"], scorer=lambda a, b: 0.9).count() == 15
    for bad in ({"max_block_size": 1}, {"sample_rate": 0}, {"workers": 0}, {"oversized_block_behavior": "x"}, {"scorer": "x"}, {"normalization": "x"}):
        with pytest.raises(ValueError):
            duplicates.find_duplicate_candidates(block, "b", ["n"], **bad)


def test_missing_rapidfuzz(spark):
    with pytest.raises(RuntimeError, match="rapidfuzz"):
        duplicates.find_duplicate_candidates(frame(spark, ["b", "n"], ("k", "x")), "b", ["n"], scorer="rapidfuzz")


def test_redaction(spark):
    df = frame(spark, ["id", "name"], ("1", "Ann"), ("2", "")).drop("_pos")
    assert [r["name"] for r in redaction.redact(df, ["name"]).collect()] == ["[redacted]", ""]
    import hashlib

    assert redaction.redact(df, ["name"], "hash").first()["name"] == hashlib.sha256(b"Ann").hexdigest()[:16]
    with pytest.raises(ValueError):
        redaction.redact(df, ["name"], "other")


def test_histogram_and_charts(spark):
    df = frame(spark, ["x"], ("0.1",), ("0.2",), ("0.8",), ("0.9",))
    bins = histogram.score_histogram(df, "x", 4)
    assert [r["n"] for r in bins.collect()] == [2, 0, 0, 2]
    svg = writers.histogram_chart(bins, "Scores", 0.5)
    assert "10%-30%" in svg and "n=4" in svg
    assert histogram.score_histogram(frame(spark, ["x"], ("5",)), "x").count() == 1
    with pytest.raises(ValueError):
        histogram.score_histogram(df, "x", 0)


def test_hygiene(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b'id,name,city\n1,a,b\n2,"x\ny",c\n3,a\n4,a,b,c\n')
    rows = [(r["issue_type"], r["line_number"]) for r in hygiene.analyze(spark, str(bad)).collect()]
    assert rows == [("embedded_newline", 3), ("column_count", 4), ("column_count", 5)]
    nul = tmp_path / "nul.csv"
    nul.write_bytes(b"a,b\n1\x00,\x002\n")
    assert hygiene.strip_nul_bytes(str(nul), str(tmp_path / "clean.csv")) == 2
    assert [r["issue_type"] for r in hygiene.analyze(spark, str(tmp_path / "clean.csv")).collect()] == ["ok"]
    assert hygiene.examine(b"a\n\xff\n")[2][0][:2] == ("encoding", 2)
    found = hygiene.report(spark, str(bad))
    assert (found["ok"], found["header_columns"], found["data_rows"], len(found["issues"])) == (False, 3, 4, 3)
    assert hygiene.report(spark, str(tmp_path / "clean.csv"))["ok"]


def test_profile_ranks_are_cut_before_the_shuffle(spark):
    df = frame(spark, ["a", "b"], *[(f"v{i % 7}", f"x{i}") for i in range(50)])
    plan = profile.profile_columns(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3 * 2
    row = profile.profile_columns(df, ["a"], top_n=3).first()
    assert [tuple(t) for t in row["top_values"]] == [("v0", 8), ("v1", 7), ("v2", 7)] and row["invalid_examples"] == []
    assert profile.profile_columns(df, ["a"], top_n=0).first()["top_values"] == []
    one = review.extended_profile(df, ["b"]).first()
    assert one["samples"] == [f"x{i}" for i in range(5)] and review.extended_profile(frame(spark, ["e"], ("",))).first()["samples"] == []
    report_ = review.normalization_report(frame(spark, ["c"], ("ACME Inc",), ("acme",), ("",)), {"c": "company"}).first()
    assert [tuple(s) for s in report_["samples"]] == [("ACME Inc", "acme")] and (report_["rows"], report_["changed"], report_["failed"]) == (3, 1, 0)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"say ""hi"""\n\n2\n')
    (tmp_path / "a.tsv").write_text("id\tnote\n1\tx\n")
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'say "hi"'), ("2", "")]
    assert readers.read_table(spark, str(tmp_path / "a.tsv")).first()["note"] == "x"
    with pytest.raises(ValueError):
        readers.resolve_format("a.bin")
    assert [len(c) for c in readers.chunks(range(5), 2)] == [2, 2, 1]
    with pytest.raises(ValueError, match="chunk_size must be >= 1"):
        list(readers.chunks([], 0))
    with pytest.raises(ValueError):
        readers.load_recipe("x.yaml")
    back = readers.from_pandas(spark, pd.DataFrame({"a": [10.5, None], "b": ["x", None]})).collect()
    assert [tuple(r) for r in back] == [("10.5", "x"), ("", "")]


def test_api(spark):
    pdf = pd.DataFrame({"l": ["a", "a"], "r": ["1", "2"]})
    assert api.mapping_conflicts(pdf, "l", "r").count() == 1
    with pytest.raises(ValueError, match="Unsupported API engine"):
        api.profile(pdf, engine="other")


def test_cli_and_report(spark, tmp_path, capsys):
    data = tmp_path / "d.csv"
    data.write_text("id,cluster,score,name\n1,c1,0.9,Ann\n2,c1,0.7,Ann\n3,c2,0.8,Bob\n")
    out = tmp_path / "o.csv"
    assert cli.main(["mappings", str(data), "--left", "cluster", "--right", "name"], spark) == 0
    assert cli.main(["mappings", str(data), "--left", "cluster", "--right", "id", "--out", str(out)], spark) == 1
    assert "1|2" in out.read_text()
    assert cli.main(["lookup", str(data), "--id", "id", "--value", "9"], spark) == 1
    assert cli.main(["mappings", str(data), "--left", "none", "--right", "id"], spark) == 2
    assert cli.main(["hygiene", str(data)], spark) == 0
    recipe = tmp_path / "r.toml"
    recipe.write_text(
        f'input = "{data}"\nout_dir = "{tmp_path}/out"\ncluster = "cluster"\nmatch_columns = ["score"]\nredact = ["name"]\nlarge_cluster_size = 2\nmax_output_rows = 1\n'
        '[[mappings]]\nleft = "cluster"\nright = "id"\n[duplicates]\nblock = "cluster"\nmatch = ["name"]\nid = "id"\nthreshold = 0.9\n'
    )
    assert cli.main(["report", "--config", str(recipe)], spark) == 0
    page = (tmp_path / "out/report.html").read_text()
    assert "Showing first 1 of" in page and "Ann" not in page and "large_cluster" in (tmp_path / "out/clusters.csv").read_text()
    assert (tmp_path / "out/match_score_distribution.svg").exists() and "1,2" in (tmp_path / "out/duplicate_candidates.csv").read_text()


def test_cli_options(spark, tmp_path, capsys):
    def run(code, *args):
        assert cli.main([str(a) for a in args], spark) == code

    def rows(name):
        with open(tmp_path / name, newline="") as f:
            return list(csv.reader(f))

    data, other, out = tmp_path / "d.csv", tmp_path / "e.tsv", tmp_path / "o.csv"
    data.write_text("id,cluster,score,name,copy\n1,c1,0.9,Ann,Ann\n2,c1,0.7,Ann,Ann\n3,c2,0.8,Bob,Bob\n")
    other.write_bytes("id\tcluster\n1\tc1\n2\tc2\n3\tc2\n4\té\n".encode("latin-1"))
    run(0, "pair-profile", data, "--out", out, "--identical-out", tmp_path / "same.csv", "--single-line")
    assert rows("same.csv") == [["left_column", "right_column", "compared_rows"], ["name", "copy", "3"]]
    assert rows("o.csv")[0] == ["column", "value", "count", "total_rows", "ratio"] and ["name", "Ann", "2", "3", "0.6667"] in rows("o.csv")
    run(0, "clusters", data, "--cluster", "cluster", "--match-column", "score", "--chart-out", tmp_path / "c.svg", "--out", out)
    assert "c1" in (tmp_path / "c.svg").read_text() and rows("o.csv")[1][:2] == ["c1", "2"]
    run(1, "compare", data, other, "--new-encoding", "latin-1", "--new-format", "tsv", "--id", "cluster", "--member", "id", "--narrative", "--out", out)
    assert [r[:2] for r in rows("o.csv")[1:]] == [
        ["c1", "member_count_changed"], ["c2", "member_count_changed"], ["é", "added"], ["2", "member_reassigned"], ["c1", "split"], ["c2", "merged"],
    ]
    run(0, "lookup", data, "--id", "id", "--value", "1", "--cluster", "cluster", "--redact", "name,copy", "--out", out)
    assert [r[3] for r in rows("o.csv")] == ["name", "[redacted]", "[redacted]"] and rows("o.csv")[1][-1] == "c1"
    run(0, "lookup", data, "--id", "id", "--value", "1", "--cluster", "cluster", "--redact", "cluster", "--redact-mode", "hash", "--out", out)
    assert rows("o.csv")[1][-1] == rows("o.csv")[1][1] == hashlib.sha256(b"c1").hexdigest()[:16]
    listed = tmp_path / "p.csv"
    listed.write_text("left_entity_id;right_entity_id\nc1;c2\n")
    run(0, "similarity", data, listed, "--pairs-delimiter", ";", "--cluster", "cluster", "--compare", "name,copy", "--out", out)
    assert rows("o.csv")[1][:3] == ["c1", "c2", "0.0"]
    run(0, "report", data, "--out-dir", tmp_path / "r", "--cluster", "cluster", "--duplicate-block", "cluster", "--duplicate-match", "name", "--duplicate-max-block-size", "5",
        "--duplicate-sample-rate", "1", "--duplicate-workers", "2", "--duplicate-oversized-block-behavior", "warn", "--max-output-rows", "2", "--mapping", "cluster:id")
    assert rows("r/mapping_cluster_to_id.csv")[1][0] == "c1" and len(rows("r/duplicate_candidates.csv")) == 2
    assert "Showing first 2 of 5" in (tmp_path / "r/report.html").read_text() and len(rows("r/profile.csv")) == 6
    run(2, "report", data, "--out-dir", tmp_path / "q", "--duplicate-block", "cluster", "--duplicate-match", "name", "--duplicate-max-block-size", "1")
    for bad in (["profile", "a", "--format", "doc"], ["duplicates", "a", "--block", "b", "--match", "m", "--scorer", "x"], ["none"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad, spark)
        assert e.value.code == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"], spark)
    assert e.value.code == 0 and "tabulon" in capsys.readouterr().out


def test_encodings(spark, tmp_path):
    for name in ("latin-1", "cp1252", "utf-16", "utf8", "utf-8-sig", "iso8859-15"):
        (tmp_path / "a.csv").write_text("id,name\n1,é\n", encoding=name)
        assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), name).collect()] == [("1", "é")], name
    with pytest.raises(ValueError, match="Unknown encoding"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), "none")


def test_scan_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n" + "".join(f"{i},v\n" for i in range(5)))
    parts = list(readers.scan_csv(spark, str(tmp_path / "a.csv"), 2))
    assert [len(p) for p in parts] == [2, 2, 1] and parts[2] == [{"id": "4", "x": "v"}]


def test_sheet_names():
    taken = {"Summary"}
    assert writers.sheet_name("Summary", taken) == "Summary 2" and writers.sheet_name("A[B]C:D*E?F/", taken) == "A_B_C_D_E_F_"
    assert len(writers.sheet_name("x" * 50, taken)) == 31 and writers.sheet_name("  ", taken) == "Section"


def test_optional_outputs(spark, tmp_path):
    for f in (lambda: writers.workbook([], str(tmp_path / "a.xlsx")), lambda: writers.pdf_report("a.html", "a.pdf")):
        with pytest.raises(RuntimeError):
            f()


def test_review_tier(spark):
    assert one(spark, review.company, "ACME, Inc.") == ["acme"] and one(spark, review.phone, "+1 (2)") == ["+12"]
    assert one(spark, review.address, "1 N. St") == ["1 north street"] and one(spark, review.date, "1/2/2026") == ["2026-01-02"]
    labelled = spark.createDataFrame([(0.9, "yes"), (0.6, "yes"), (0.5, "no")], "score double, label string")
    assert review.calibrate_threshold(labelled).first()["threshold"] == pytest.approx(0.55)
    assert review.calibrate_threshold(labelled.limit(0)).first()["threshold"] == 0.7


def test_report_settings():
    assert report.setting("encoding", {}, {"encoding": "latin-1"}) == "latin-1"
    assert report.mapping_specs(["a:b", {"left": "c", "right": "d"}]) == [("a", "b"), ("c", "d")]
    with pytest.raises(ValueError):
        report.mapping_specs(["ab"])


def test_tfidf_reads_the_texts(spark, tmp_path):
    import collections
    import itertools
    import math
    import re

    from tabulon import queries

    texts = [("a", "Red apples and red wine"), ("a", "wine x"), ("b", "green apples, épée"), ("c", "Épée and wine; WINE"), ("c", None)]
    rows = [(i, t, "en", s, 1) for i, (s, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    tf = collections.defaultdict(collections.Counter)
    for s, t in texts:
        tf[s].update(re.findall(r"\w\w+", (t or "").lower()))
    df = collections.Counter(w for c in tf.values() for w in c)
    w = {s: {t: n * (math.log(4 / (1 + df[t])) + 1) for t, n in c.items()} for s, c in tf.items()}
    norm = {s: math.sqrt(sum(x * x for x in c.values())) for s, c in w.items()}
    want = {(p, q): round(sum(x * w[q].get(t, 0) for t, x in w[p].items()) / norm[p] / norm[q], 4) for p, q in itertools.combinations("abc", 2)}
    got = queries.QUERIES["similarity_tfidf_text"](spark, str(tmp_path)).collect()
    assert {(r["left_cluster"], r["right_cluster"]): r["similarity"] for r in got} == want


def clustered(spark):
    rows = [("c", "1", "x", "+1 2"), ("c", "2", "x ", "12"), ("c", "2", "y", "12"), ("c", "3", "x", ""), ("c", "3", "x", "+12"), ("d", "4", "x", ""), ("d", "4", "x", ""), ("", "5", "x", ""), ("e", "6", "", "1"), ("e", "7", "", "1")]
    return frame(spark, ["c", "id", "v", "w"], *rows)


def made_pairs(spark, *scorers):
    """{cluster: [(id, id2, score, ...)]} of every pair, made one by one."""
    got = {}
    for r in review.cluster_pairs(clustered(spark), "c", "id", dict(zip("vw", scorers, strict=False))).collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    assert sorted(map(len, got.values())) == [1, 8]
    return got


def no_pairs(*_):
    raise AssertionError("pairs are counted, not made")


def test_field_scores_count_equal_pairs(spark, monkeypatch):
    want = {(c, f): sum(p[2 + i] for p in ps) / len(ps) for c, ps in made_pairs(spark, review.exact, review.exact_normalized).items() for i, f in enumerate("vw")}
    monkeypatch.setattr(review, "cluster_pairs", no_pairs)
    got = review.field_scores(clustered(spark), "c", "id", {"v": review.exact, "w": review.exact_normalized}).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == 4


def test_within_cluster_scores_count_equal_pairs(spark, monkeypatch):
    want = {}
    for c, ps in made_pairs(spark, review.exact, review.exact_normalized).items():
        whole = sum((p[2] + p[3]) / 2 for p in ps) / len(ps)
        for i in {x for p in ps for x in p[:2]}:
            own = [(p[2] + p[3]) / 2 for p in ps if i in p[:2]]
            want[c, i] = (pytest.approx(sum(own) / len(own)), pytest.approx(whole))
    monkeypatch.setattr(review, "cluster_pairs", no_pairs)
    got = review.within_cluster_scores(clustered(spark), "c", "id", {"v": review.exact, "w": review.exact_normalized}).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want and len(got) == 5
    monkeypatch.undo()
    mixed = review.within_cluster_scores(clustered(spark), "c", "id", {"v": lambda a, b: review.exact(a, b), "w": review.exact_normalized}).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in mixed} == want


def test_sanity_checks_count_equal_pairs(spark, tmp_path, monkeypatch):
    from tabulon import queries

    kept = [s for ps in made_pairs(spark, review.exact).values() for *_, s in ps]
    found = review.pair_scores(clustered(spark), "c", "id", "v", review.exact)
    scores, fields = (f(clustered(spark), "c", "id", {"v": review.exact}) for f in (review.within_cluster_scores, review.field_scores))
    last = review.sanity_checks(scores, fields, found, repeats="n").collect()[-1]
    assert tuple(last) == ("most_pairs_match", sum(kept) / len(kept), True) and sum(r["n"] for r in found.collect()) == len(kept)
    assert review.pair_scores(clustered(spark), "c", "id", "v", lambda a, b: review.exact(a, b)).exceptAll(found).count() == 0
    once = spark.createDataFrame([(s,) for s in kept], "score double")
    assert tuple(review.sanity_checks(scores, fields, once).collect()[-1]) == tuple(last)
    assert tuple(review.sanity_checks(scores, fields, once.limit(0)).collect()[-1]) == ("most_pairs_match", None, False)
    spark.createDataFrame([(i, "b", i % 2, "t") for i in range(5)], "p_partkey long, p_brand string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(review, "cluster_pairs", no_pairs)
    rows = {r[0]: (r[1], r[2]) for r in queries.QUERIES["sanity_checks"](spark, str(tmp_path)).collect()}
    assert rows["most_pairs_match"] == (0.4, False) and rows["low_field"] == (0.6, True) and rows["scores_near_zero"] == (0.7, False)


@pytest.mark.parametrize("scorer", ["difflib", "jaccard", "levenshtein"])
def test_duplicates_score_values_once(spark, tmp_path, monkeypatch, scorer):
    """Scores are made for values, not rows, and pairs come whole and best first."""
    plain = {"difflib": duplicates.ratio, "jaccard": lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)), "levenshtein": lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)}[scorer]

    def noted(a, b):
        with open(tmp_path / "calls", "a") as f:
            f.write(f"{scorer}\n")
        return plain(a, b)

    if scorer == "difflib":
        monkeypatch.setattr(duplicates, "ratio", noted)
    else:
        made = F.udf(noted, "double")
        monkeypatch.setattr(duplicates, scorer, lambda a, b: made(a, b))
    monkeypatch.setattr(duplicates, "TILE", 7)
    names = ["red bolt", "bad bolt", "red bold", "bolt red"]
    rows = [("k", names[i % 4], f"t{i * 7 % 400}") for i in range(300)] + [("m", "red bolt", ""), ("m", "red bolt", "t5"), ("m", "red bolt", "t5")]
    df = frame(spark, ["b", "n", "id"], *rows)
    got = [tuple(r)[:4] for r in duplicates.find_duplicate_candidates(df, "b", ["n"], "id", 0.5, scorer).collect()]
    value = (lambda t: t.split(" ")) if scorer == "jaccard" else (lambda t: t)
    want, place = [], {"k": 0, "m": 0}
    at = []
    for k, n, i in rows:
        at.append((k, place[k], i or str(place[k]), value(n)))
        place[k] += 1
    first = {"k": 0, "m": 300}
    for x in range(len(at)):
        for y in range(x + 1, len(at)):
            (k, b, i, n), (k2, b2, j, n2) = at[x], at[y]
            if k == k2 and (s := plain(n, n2)) >= 0.5:
                want.append((-s, i, first[k], b, b2, (k, i, j, s)))
    assert got == [w[-1] for w in sorted(want)] and len(got) > 10000
    calls = (tmp_path / "calls").read_text().count("\n")
    assert calls <= 2 * (16 + 1)  # each two values once; Spark may evaluate a column again for a filter


def test_duplicates_of_two_columns_in_order(spark):
    rows = [("k", ("red bolt", "red", "a")[i % 3], ("x y", "x")[i % 2], str(i)) for i in range(40)]
    got = duplicates.find_duplicate_candidates(frame(spark, ["b", "n", "m", "id"], *rows), "b", ["n", "m"], "id", 0.5, "jaccard").collect()
    alike = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = []
    for x in range(40):
        for y in range(x + 1, 40):
            n, m = alike(rows[x][1], rows[y][1]), alike(rows[x][2], rows[y][2])
            if (n + m) / 2 >= 0.5:
                want.append((-(n + m) / 2, str(x), x, y, ("k", str(x), str(y), (n + m) / 2, {"n": n, "m": m})))
    assert [tuple(r) for r in got] == [w[-1] for w in sorted(want, key=lambda w: w[:4])]
