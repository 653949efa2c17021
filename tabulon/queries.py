"""Review operators as queries over the tables, each with the same in SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clusters, compare, duplicates, histogram, lookup, mappings, pairs, profile, redaction, review, similarity
from .sources import hygiene


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MAPPING = """SELECT l AS left_value, count(DISTINCT r) AS right_count, string_agg(DISTINCT r, '|' ORDER BY r) AS right_values
FROM ({}) WHERE {} GROUP BY l HAVING count(DISTINCT r) > 1"""


@query(MAPPING.format("SELECT CAST(o_custkey AS VARCHAR) l, trim(o_orderpriority) r FROM orders", "l <> '' AND r <> ''"))
def mapping_conflicts(spark, sf):
    return mappings.flat_mappings(mappings.find_one_to_many_mappings(table(spark, sf, "orders"), "o_custkey", "o_orderpriority"))


BLANKED = "CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS {}) END"


@query(MAPPING.format(f"SELECT {BLANKED.format('VARCHAR')} l, event_type r FROM events", "true"))
def mapping_conflicts_keep_blank(spark, sf):
    df = table(spark, sf, "events").withColumn("u", F.expr(BLANKED.format("STRING")))
    return mappings.flat_mappings(mappings.find_one_to_many_mappings(df, "u", "event_type", ignore_blank=False))


@query("""WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) cluster_id, count(*) AS size, (sum(l_discount) + sum(l_tax)) / (2 * count(*)) AS a FROM lineitem GROUP BY 1)
SELECT cluster_id, size, CASE WHEN size <= 1 THEN '1' WHEN size <= 5 THEN '2-5' WHEN size <= 10 THEN '6-10' WHEN size <= 25 THEN '11-25' WHEN size <= 50 THEN '26-50'
 WHEN size <= 100 THEN '51-100' WHEN size <= 250 THEN '101-250' WHEN size <= 500 THEN '251-500' ELSE '500+' END AS size_bucket,
 round(a, 4) AS average_match_score,
 round(least(1.0, (CASE WHEN size >= 10 THEN 0.5 ELSE 0 END) + (CASE WHEN a < 0.85 THEN least(1.0, 0.85 - a + 0.5) * 0.5 ELSE 0 END)), 4) AS outlier_score,
 concat_ws('|', CASE WHEN size >= 10 THEN 'large_cluster' END, CASE WHEN a < 0.85 THEN 'low_match_score' END) AS outlier_reason FROM c""")
def cluster_summary(spark, sf):
    df = clusters.summarize_clusters(table(spark, sf, "lineitem"), "l_suppkey", ["l_discount", "l_tax"])
    return df.withColumn("average_match_score", F.round("average_match_score", 4)).withColumn("outlier_score", F.round("outlier_score", 4))


UNPIVOT = """long AS (SELECT 'c_name' AS "column", trim(c_name) AS v, c_custkey AS p FROM customer
 UNION ALL SELECT 'c_mktsegment', trim(c_mktsegment), c_custkey FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), c_custkey FROM customer)"""
PROFILED = ["c_name", "c_mktsegment", "c_nationkey"]


def customer_profile(spark, sf, top_n=10):
    return profile.profile_columns(table(spark, sf, "customer"), PROFILED, top_n=top_n, order_by="c_custkey")


DUMMY = "('', '0', '-1', '1900-01-01', '9999-12-31', 'n/a', 'na', 'none', 'null', 'sample', 'test', 'undefined', 'unknown')"


@query(f"""WITH {UNPIVOT} SELECT "column", count(*) AS total_rows, count(*) FILTER (v = '') AS blank_count, count(*) FILTER (lower(v) IN {DUMMY}) AS null_like_count,
 count(DISTINCT v) AS unique_count, round(count(DISTINCT v) / count(*), 4) AS unique_ratio FROM long GROUP BY 1""")
def profile_basic(spark, sf):
    return customer_profile(spark, sf).select("column", "total_rows", "blank_count", "null_like_count", "unique_count", "unique_ratio")


@query(f"""WITH {UNPIVOT}, f AS (SELECT "column", v, count(*) n, min(p) p FROM long GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, p) k FROM f)
 SELECT "column", CAST(k AS INTEGER) AS rank, v AS value, n FROM r WHERE k <= 5""")
def profile_top_values(spark, sf):
    tops = customer_profile(spark, sf, 5).select("column", F.posexplode("top_values").alias("i", "t"))
    return tops.select("column", (F.col("i") + 1).alias("rank"), F.col("t.value").alias("value"), F.col("t.n").alias("n"))


@query("""SELECT 'c_acctbal' AS "column", 'numeric' AS inferred_type, round(min(x), 2) AS min_value, round(quantile_cont(x, 0.25), 2) AS q1, round(quantile_cont(x, 0.5), 2) AS median,
 round(quantile_cont(x, 0.75), 2) AS q3, round(max(x), 2) AS max_value FROM (SELECT c_acctbal x FROM customer)
 UNION ALL SELECT 'o_totalprice', 'numeric', round(min(x), 2), round(quantile_cont(x, 0.25), 2), round(quantile_cont(x, 0.5), 2), round(quantile_cont(x, 0.75), 2), round(max(x), 2) FROM (SELECT o_totalprice x FROM orders)""")
def profile_quantiles(spark, sf):
    cols = ["min_value", "q1", "median", "q3", "max_value"]
    both = profile.profile_columns(table(spark, sf, "customer"), ["c_acctbal"]).unionByName(profile.profile_columns(table(spark, sf, "orders"), ["o_totalprice"]))
    return both.select("column", "inferred_type", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in cols))


@query("""SELECT 'o_orderdate' AS "column", 'datetime' AS inferred_type, 1.0::DOUBLE AS datetime_parse_rate, strftime(min(o_orderdate), '%Y-%m-%d') AS min_value, strftime(max(o_orderdate), '%Y-%m-%d') AS max_value FROM orders""")
def profile_datetime(spark, sf):
    df = profile.profile_columns(table(spark, sf, "orders"), ["o_orderdate"])
    return df.select("column", "inferred_type", "datetime_parse_rate", "min_value", "max_value")


@query("""WITH m AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'pending ' || c_custkey END AS bad FROM customer),
 x AS (SELECT 'account_id' AS "column", c_custkey AS k, CAST(c_custkey AS VARCHAR) AS v, CAST(c_custkey AS DOUBLE) AS x, NULL AS d FROM m WHERE c_custkey <> 0 UNION ALL SELECT 'balance', c_custkey, bad, CASE WHEN bad IS NULL THEN round(c_acctbal, 2) END, NULL FROM m
  UNION ALL SELECT 'opened', c_custkey, bad, NULL, CASE WHEN bad IS NULL THEN DATE '2024-01-31' + CAST(c_custkey % 400 AS INTEGER) END FROM m)
 SELECT "column", CASE "column" WHEN 'account_id' THEN 'identifier' WHEN 'balance' THEN 'currency' ELSE 'datetime' END AS inferred_type, "column" = 'account_id' AS likely_unique_id, "column" = 'balance' AS currency_like,
 round(count(x) / count(*), 4) AS numeric_parse_rate, CASE WHEN "column" = 'opened' THEN round(count(d) / count(*), 4) END AS datetime_parse_rate, min(x) AS low, max(x) AS high, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day,
 CASE WHEN "column" <> 'account_id' THEN array_to_string((list(v ORDER BY k) FILTER (v IS NOT NULL))[1:3], '|') ELSE '' END AS invalid_examples FROM x GROUP BY 1""")
def profile_text_types(spark, sf):
    """Amounts and days written as people write them, some of them not at all."""
    bad = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("pending "), F.col("c_custkey").cast("string")))
    amount, size = F.col("c_acctbal").cast("decimal(20,2)"), F.format_number(F.abs("c_acctbal"), 2)
    money = F.when(amount < 0, F.concat(F.lit("($"), size, F.lit(")"))).otherwise(F.concat(F.lit("$"), size))
    day = F.date_format(F.date_add(F.lit("2024-01-31").cast("date"), (F.col("c_custkey") % 400).cast("int")), "MM/dd/yyyy")
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("_pos"), F.col("c_custkey").alias("account_id"), F.coalesce(bad, money).alias("balance"), F.coalesce(bad, day).alias("opened"))
    p, moment = profile.profile_columns(df), F.col("column") == "opened"
    number, text = (lambda c: F.when(~moment, F.col(c).cast("double"))), (lambda c: F.when(moment, F.col(c)))
    return p.select(
        "column", "inferred_type", "likely_unique_id", "currency_like", "numeric_parse_rate", text("datetime_parse_rate").alias("datetime_parse_rate"), number("min_value").alias("low"),
        number("max_value").alias("high"), text("min_value").alias("first_day"), text("max_value").alias("last_day"), F.array_join("invalid_examples", "|").alias("invalid_examples"),
    )


@query("""WITH long AS (SELECT 'p_brand' AS "column", p_brand AS v, p_partkey AS p FROM part UNION ALL SELECT 'p_name', p_name, p_partkey FROM part UNION ALL SELECT 'p_half', CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END, p_partkey FROM part),
 f AS (SELECT "column", v, count(*) n, min(p) p FROM long GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY "column") t, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, p) k FROM f)
 SELECT "column", v AS value, n AS count, CAST(t AS BIGINT) AS total_rows, round(n / t, 4) AS ratio FROM r WHERE k = 1 AND n / t >= 0.02""")
def grouping_candidates(spark, sf):
    half = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END")
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("_pos"), "p_brand", "p_name", half.alias("p_half"))
    return pairs.find_grouping_candidates(df, 0.02)


@query("""SELECT 'n_name' AS left_column, 'copy' AS right_column, count(*) AS compared_rows FROM nation HAVING bool_and(n_name = n_name || '')""")
def identical_pairs(spark, sf):
    return pairs.find_identical_column_pairs(table(spark, sf, "nation").withColumn("copy", F.concat("n_name", F.lit(""))))


BLOCKS = """p AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS block, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS v FROM part),
 pairs AS (SELECT l.block AS block_value, CAST(l.id AS VARCHAR) AS left_id, CAST(r.id AS VARCHAR) AS right_id, l.v AS a, r.v AS b FROM p l JOIN p r ON l.block = r.block AND l.id < r.id)"""


def part_duplicates(spark, sf, scorer, threshold, **options):
    df = table(spark, sf, "part").withColumn("block", F.concat_ws(" ", "p_brand", "p_type"))
    found = duplicates.find_duplicate_candidates(df, "block", ["p_name"], "p_partkey", threshold, scorer, order_by="p_partkey", **options)
    return found.select("block_value", "left_id", "right_id", F.round("score", 4).alias("score"))


@query(f"""WITH {BLOCKS}, s AS (SELECT *, list_distinct(string_split(a, ' ')) x, list_distinct(string_split(b, ' ')) y FROM pairs),
 t AS (SELECT *, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS score FROM s)
 SELECT block_value, left_id, right_id, round(score, 4) AS score FROM t WHERE score >= 0.5""")
def duplicates_jaccard(spark, sf):
    return part_duplicates(spark, sf, "jaccard", 0.5)


@query(f"""WITH {BLOCKS}, t AS (SELECT *, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS score FROM pairs)
 SELECT block_value, left_id, right_id, round(score, 4) AS score FROM t WHERE score >= 0.6""")
def duplicates_levenshtein(spark, sf):
    return part_duplicates(spark, sf, "levenshtein", 0.6)


@query()
def duplicates_difflib(spark, sf):
    return part_duplicates(spark, sf, "difflib", 0.85)


def fraction(*parts):
    return f"CAST('0x' || substr(md5(concat_ws(chr(31), {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(f"""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_brand || ' ' || p_type AS block, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS x FROM part),
 n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY k) - 1 AS b FROM p), d AS (SELECT *, {fraction("block", "CAST(b AS VARCHAR)", "id")} AS draw FROM n),
 r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY block ORDER BY draw, b) <= 12),
 s AS (SELECT l.block AS block_value, l.id AS left_id, r.id AS right_id, len(list_intersect(l.x, r.x)) / len(list_distinct(list_concat(l.x, r.x))) AS score
  FROM r l JOIN r ON l.block = r.block AND l.b < r.b WHERE {fraction("l.block", "CAST(l.b AS VARCHAR)", "l.id", "CAST(r.b AS VARCHAR)", "r.id")} < 0.5)
 SELECT block_value, left_id, right_id, round(score, 4) AS score FROM s WHERE score >= 0.5""")
def duplicates_sampled(spark, sf):
    return part_duplicates(spark, sf, "jaccard", 0.5, sample_rate=0.5, max_block_size=12, oversized_block_behavior="sample")


OLD, NEW = "CAST(o_custkey AS {t})", "CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_custkey END AS {t})"
SIDES = f"""o AS (SELECT {OLD.format(t="VARCHAR")} AS id, CAST(o_orderkey AS VARCHAR) AS m, o_orderkey AS p FROM orders),
 n AS (SELECT * FROM (SELECT {NEW.format(t="VARCHAR")} AS id, CAST(o_orderkey AS VARCHAR) AS m, o_orderkey AS p FROM orders) WHERE id IS NOT NULL)"""
DRIFT = """a AS (SELECT id, list_sort(list(DISTINCT m)) s FROM o GROUP BY 1), b AS (SELECT id, list_sort(list(DISTINCT m)) s FROM n GROUP BY 1),
 d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.s IS NULL THEN 'removed' WHEN a.s IS NULL THEN 'added' WHEN len(a.s) <> len(b.s) THEN 'member_count_changed' ELSE 'members_changed' END AS difference,
  coalesce(array_to_string(a.s, '|'), '') AS old_members, coalesce(array_to_string(b.s, '|'), '') AS new_members FROM a FULL JOIN b ON a.id = b.id WHERE a.s IS DISTINCT FROM b.s)"""


def two_exports(spark, sf):
    orders = table(spark, sf, "orders")
    side = lambda e: orders.select(F.expr(e.format(t="STRING")).alias("id"), F.col("o_orderkey").cast("string").alias("m"), F.col("o_orderkey").alias("_pos"))
    return side(OLD), side(NEW)


@query(f"WITH {SIDES}, {DRIFT} SELECT * FROM d")
def compare_exports(spark, sf):
    return compare.flat_differences(compare.compare_export_membership(*two_exports(spark, sf), "id", "m"))


@query(f"""WITH {SIDES}, {DRIFT},
 ow AS (SELECT o.m, o.id AS old_id, n.id AS new_id FROM o LEFT JOIN n ON o.m = n.m), nw AS (SELECT n.m, o.id AS old_id, n.id AS new_id FROM n LEFT JOIN o ON o.m = n.m),
 w AS (SELECT * FROM ow WHERE new_id IS NOT NULL),
 x AS (SELECT id, 'member_reassigned' AS difference, old_members, new_members FROM (SELECT m AS id, old_id AS old_members, new_id AS new_members FROM w WHERE old_id <> new_id)),
 y AS (SELECT old_id AS id, 'split' AS difference, string_agg(DISTINCT m, '|' ORDER BY m) AS old_members, string_agg(DISTINCT new_id, '|' ORDER BY new_id) AS new_members FROM ow GROUP BY old_id HAVING count(DISTINCT new_id) > 1),
 z AS (SELECT new_id AS id, 'merged' AS difference, string_agg(DISTINCT old_id, '|' ORDER BY old_id) AS old_members, string_agg(DISTINCT m, '|' ORDER BY m) AS new_members FROM nw GROUP BY new_id HAVING count(DISTINCT old_id) > 1)
 SELECT * FROM d UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z""")
def compare_narratives(spark, sf):
    return compare.flat_differences(compare.compare_export_membership(*two_exports(spark, sf), "id", "m", include_narratives=True))


@query("""WITH f AS (SELECT c_nationkey FROM customer WHERE c_custkey = 7) SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey = 7 THEN 'match' ELSE 'cluster_sibling' END AS _lookup_relationship,
 CAST(c_nationkey AS VARCHAR) AS _lookup_cluster FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM f)""")
def lookup_siblings(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return lookup.lookup_entity(df, "c_custkey", "7", "c_nationkey", order_by="c_custkey")


CROSS = "SELECT a.s AS l, b.s AS r FROM (SELECT DISTINCT source s FROM documents) a JOIN (SELECT DISTINCT source s FROM documents) b ON a.s < b.s"


def source_pairs(spark, sf):
    s = table(spark, sf, "documents").select(F.col("source").alias("l")).distinct()  # twenty sources
    return s.join(s.withColumnRenamed("l", "r"), F.col("l") < F.col("r"))


def source_similarity(spark, sf, method, column):
    df = similarity.compare_cluster_pairs(table(spark, sf, "documents"), source_pairs(spark, sf), "source", "l", "r", [column], method)
    return df.select("left_cluster", "right_cluster", F.round("similarity", 4).alias("similarity"), "band", "recommendation")


BAND = """CASE WHEN s >= 0.85 THEN 'likely_match' WHEN s >= 0.65 THEN 'review' ELSE 'low_similarity' END AS band,
 CASE WHEN s >= 0.85 THEN 'prioritize_review' WHEN s >= 0.65 THEN 'review_if_relevant' ELSE 'ignore_unless_context_requires' END AS recommendation"""


@query(f"""WITH t AS (SELECT source AS c, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents), u AS (SELECT DISTINCT c, lower(w) AS w FROM t),
 n AS (SELECT c, count(*) AS n FROM u GROUP BY c), p AS ({CROSS}), i AS (SELECT x.c AS l, y.c AS r, count(*) AS k FROM u x JOIN u y ON x.w = y.w AND x.c < y.c GROUP BY ALL),
 s AS (SELECT p.l, p.r, coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)) AS s FROM p LEFT JOIN i ON p.l = i.l AND p.r = i.r JOIN n a ON a.c = p.l JOIN n b ON b.c = p.r)
 SELECT l AS left_cluster, r AS right_cluster, round(s, 4) AS similarity, {BAND} FROM s""")
def similarity_jaccard(spark, sf):
    return source_similarity(spark, sf, "jaccard", "text")


@query(f"""WITH t AS (SELECT source AS c, unnest(regexp_extract_all(lower(lang || ' ' || lang || ' ' || CAST(n_chars AS VARCHAR)), '[a-z0-9_]{{2,}}')) AS w FROM documents),
 tf AS (SELECT c, w, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), n AS (SELECT count(DISTINCT source) AS n FROM documents),
 x AS (SELECT c, tf.w, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS x FROM tf JOIN df ON tf.w = df.w, n), m AS (SELECT c, sqrt(sum(x * x)) AS m FROM x GROUP BY c),
 u AS (SELECT x.c, w, x / m AS x FROM x JOIN m ON x.c = m.c), p AS ({CROSS}),
 d AS (SELECT a.c AS l, b.c AS r, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.w = b.w AND a.c < b.c GROUP BY ALL),
 s AS (SELECT p.l, p.r, coalesce(d.s, 0) AS s FROM p LEFT JOIN d ON p.l = d.l AND p.r = d.r)
 SELECT l AS left_cluster, r AS right_cluster, round(s, 4) AS similarity, {BAND} FROM s""")
def similarity_tfidf(spark, sf):
    docs = table(spark, sf, "documents").withColumn("body", F.concat_ws(" ", "lang", "lang", "n_chars"))
    df = similarity.compare_cluster_pairs(docs, source_pairs(spark, sf), "source", "l", "r", ["body"], "tfidf")
    return df.select("left_cluster", "right_cluster", F.round("similarity", 4).alias("similarity"), "band", "recommendation")


@query()
def similarity_tfidf_text(spark, sf):
    """The texts themselves; SQL has other word characters, so brute force is the test."""
    return source_similarity(spark, sf, "tfidf", "text")


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS c_name, substr(sha256(c_mktsegment), 1, 16) AS c_mktsegment FROM customer")
def redact_hash(spark, sf):
    return redaction.redact(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "hash")


@query("SELECT c_custkey, '[redacted]' AS c_name, c_mktsegment FROM customer")
def redact_mask(spark, sf):
    return redaction.redact(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name"])


@query("""WITH e AS (SELECT min(value) a, max(value) b FROM events), h AS (SELECT CAST(least(9, floor((value - a) / ((b - a) / 10))) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1)
 SELECT CAST(g AS INTEGER) AS bin, round(a + g * ((b - a) / 10), 4) AS low, round(CASE WHEN g = 9 THEN b ELSE a + (g + 1) * ((b - a) / 10) END, 4) AS high, coalesce(n, 0) AS n FROM e, generate_series(0, 9) s(g) LEFT JOIN h ON h.bin = g""")
def score_histogram(spark, sf):
    df = histogram.score_histogram(table(spark, sf, "events"), "value", 10)
    return df.withColumn("low", F.round("low", 4)).withColumn("high", F.round("high", 4))


@query("""SELECT source, count(*) AS rows, count(*) FILTER (contains(text, chr(10))) AS embedded_newline, sum(length(text) - length(replace(text, '"', ''))) AS quotes FROM documents GROUP BY source""")
def hygiene_text(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("rows"), F.sum(F.contains(t, F.lit("\n")).cast("long")).alias("embedded_newline"), F.sum(F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))).cast("long").alias("quotes")
    )


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey // 100 AS f, 1 + row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS n FROM customer),
 i AS (SELECT f, n, CASE k % 50 WHEN 3 THEN 'column_count' ELSE 'embedded_newline' END AS t, CASE k % 50 WHEN 3 THEN 'Expected 3 column(s), found 2.' ELSE 'Cell contains a line break.' END AS m FROM c WHERE k % 50 IN (3, 7) AND f % 4 > 0)
 SELECT 'f' || c.f AS path, 3::BIGINT AS header_columns, count(*) AS data_rows, coalesce(any_value(t), 'ok') AS issue_type, coalesce(i.n, 0) AS line_number, coalesce(any_value(m), '') AS message
 FROM c LEFT JOIN i ON c.f = i.f GROUP BY c.f, i.n""")
def hygiene_files(spark, sf):
    """A CSV file of each hundred customers; in three of four, some rows are short or hold a line break."""
    k, f = F.col("c_custkey"), F.floor(F.col("c_custkey") / 100)
    line = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), "c_name", F.when((k % 50 == 7) & (f % 4 > 0), "\n").otherwise(""), F.lit('"')), F.when((k % 50 != 3) | (f % 4 == 0), F.col("c_mktsegment")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda x: x["line"])
    files = table(spark, sf, "customer").groupBy(F.concat(F.lit("f"), f.cast("string")).alias("path")).agg(F.concat(F.lit("id,name,segment\n"), F.array_join(lines, "\n")).cast("binary").alias("content"))
    return hygiene.analyze_contents(files).drop("encoding")


@query("""SELECT p_name AS value, count(DISTINCT p_brand) AS cluster_count, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS clusters FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def cross_cluster_collisions(spark, sf):
    df = review.cross_cluster_collisions(table(spark, sf, "part"), "p_brand", "p_name")
    return df.withColumn("clusters", F.array_join("clusters", "|"))


@query("""WITH f AS (SELECT 'c_name' AS "column", c_name v, count(*) n FROM customer GROUP BY 2 UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY 2)
 SELECT "column", CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length, round(sum(length(v) * n) / sum(n), 4) AS mean_length, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows FROM f GROUP BY 1""")
def extended_profile(spark, sf):
    return review.extended_profile(table(spark, sf, "customer"), ["c_name", "c_mktsegment"]).select("column", "min_length", "max_length", "mean_length", "repeated_rows")


@query("""WITH p AS (SELECT p_brand c, CAST(p_partkey AS VARCHAR) id, p_size x FROM part), s AS (SELECT l.c, l.id a, r.id b, CASE WHEN l.x = r.x THEN 1.0 ELSE 0.0 END AS s FROM p l JOIN p r ON l.c = r.c AND l.id < r.id),
 e AS (SELECT c, a AS id, s FROM s UNION ALL SELECT c, b, s FROM s)
 SELECT c AS cluster_id, id AS record_id, round(avg(s), 4) AS record_score, round(any_value(k), 4) AS cluster_score FROM e JOIN (SELECT c AS d, avg(s) AS k FROM s GROUP BY c) ON c = d GROUP BY 1, 2""")
def within_cluster_scores(spark, sf):
    df = review.within_cluster_scores(table(spark, sf, "part"), "p_brand", "p_partkey", {"p_size": review.exact})
    return df.withColumn("record_score", F.round("record_score", 4)).withColumn("cluster_score", F.round("cluster_score", 4))


SIZED = """p AS (SELECT p_brand AS c, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS v, p_type AS t FROM part),
 s AS (SELECT l.c, (l.v = r.v)::DOUBLE AS s0, (l.t = r.t)::DOUBLE AS s1 FROM p l JOIN p r ON l.c = r.c AND l.id < r.id)"""


def brands(spark, sf):
    return table(spark, sf, "part"), "p_brand", "p_partkey", {"p_size": review.exact, "p_type": review.exact}


@query(f"""WITH {SIZED} SELECT c AS cluster_id, 'p_size' AS field, round(avg(s0), 4) AS mean_score FROM s GROUP BY 1
 UNION ALL SELECT c, 'p_type', round(avg(s1), 4) FROM s GROUP BY 1""")
def field_scores(spark, sf):
    return review.field_scores(*brands(spark, sf)).withColumn("mean_score", F.round("mean_score", 4))


@query(f"""WITH {SIZED}, c AS (SELECT c, avg((s0 + s1) / 2) AS x FROM s GROUP BY 1), f AS (SELECT avg(x) AS m FROM (SELECT avg(s0) x, c FROM s GROUP BY c) UNION ALL SELECT avg(x) FROM (SELECT avg(s1) x, c FROM s GROUP BY c)),
 r AS (SELECT 'most_clusters_flagged' AS n, avg((x < 0.8)::DOUBLE) AS v, avg((x < 0.8)::DOUBLE) > 0.9 AS t FROM c UNION ALL SELECT 'scores_near_zero', max(x), max(x) <= 0.05 FROM c
  UNION ALL SELECT 'scores_near_one', min(x), min(x) >= 0.95 FROM c UNION ALL SELECT 'low_field', max(m) - min(m), max(m) - min(m) >= 0.3 FROM f
  UNION ALL SELECT 'most_pairs_match', avg((s0 >= 0.7)::DOUBLE), avg((s0 >= 0.7)::DOUBLE) > 0.5 FROM s)
 SELECT n AS "check", round(v, 4) AS value, t AS triggered FROM r""")
def sanity_checks(spark, sf):
    given = brands(spark, sf)
    pairs = review.pair_scores(*given[:3], "p_size", review.exact)
    found = review.sanity_checks(review.within_cluster_scores(*given), review.field_scores(*given), pairs, repeats="n")
    return found.withColumn("value", F.round("value", 4))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS block_value, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS score FROM orders)
 SELECT 'confidence' AS measure, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS name, count(*) AS value FROM s GROUP BY 2
 UNION ALL SELECT 'block', block_value, count(*) FROM s GROUP BY 2""")
def pair_quality_summary(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("block_value"), (F.col("o_orderkey") % 100 / 100).alias("score"))
    return review.pair_quality_summary(df)


LOCAL = "CASE WHEN d IN ('gmail.com', 'googlemail.com') THEN replace(l, '.', '') ELSE l END"
EMAILS = f"""e AS (SELECT c_custkey AS k, 'a.' || lower(c_mktsegment) AS l1, CASE c_custkey % 3 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'x.org' ELSE 'y.org' END AS d1,
  'a' || lower(c_mktsegment) || c_custkey % 7 AS l2, CASE c_custkey % 2 WHEN 0 THEN 'gmail.com' ELSE 'x.org' END AS d2 FROM customer),
 n AS (SELECT k, {LOCAL.replace("d IN", "d1 IN").replace("(l,", "(l1,").replace("ELSE l ", "ELSE l1 ")} AS l1, d1, {LOCAL.replace("d IN", "d2 IN").replace("(l,", "(l2,").replace("ELSE l ", "ELSE l2 ")} AS l2, d2 FROM e),
 r AS (SELECT k, d1 = d2 AS same, 1 - levenshtein(l1, l2) / greatest(length(l1), length(l2)) AS x FROM n)"""


@query(f"""WITH {EMAILS} SELECT k AS c_custkey, round(CASE WHEN same THEN 0.5 + 0.5 * x ELSE least(0.5, 0.5 * x) END, 4) AS score FROM r""")
def email_composite(spark, sf):
    k, seg = F.col("c_custkey"), F.lower("c_mktsegment")
    one = F.concat(F.lit(" mailto:A."), seg, F.lit("@"), F.when(k % 3 == 0, "gmail.com").when(k % 3 == 1, "x.org").otherwise("Y.org"))
    two = F.concat(F.lit("a"), seg, (k % 7).cast("string"), F.lit("@"), F.when(k % 2 == 0, "gmail.com").otherwise("x.org"))
    return table(spark, sf, "customer").select("c_custkey", F.round(review.email_composite(one, two), 4).alias("score"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '' END || regexp_replace(CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS VARCHAR), '[^0-9]', '', 'g') AS phone,
 'north main street ' || s_suppkey AS address, 'first ' || lower(replace(s_name, '#', ' ')) AS person, 'smith and sons ' || s_nationkey AS company FROM supplier""")
def normalizers(spark, sf):
    k, plus = F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "(+").otherwise("(")
    return table(spark, sf, "supplier").select(
        "s_suppkey", review.phone(F.concat(plus, F.col("s_acctbal").cast("decimal(20,2)").cast("string"), F.lit(") x"))).alias("phone"),
        review.address(F.concat(F.lit("N. Main St, "), k.cast("string"))).alias("address"), review.person(F.concat("s_name", F.lit(", Dr. First"))).alias("person"),
        review.company(F.concat(F.lit("Smith & Sons "), F.col("s_nationkey").cast("string"), F.lit(" Ltd."))).alias("company"),
    )


@query("""WITH s AS (SELECT l_tax AS score, CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'no' END AS label FROM lineitem)
 SELECT min(score) FILTER (label = 'yes') AS lowest_yes, max(score) FILTER (label = 'no') AS highest_no, (min(score) FILTER (label = 'yes') + max(score) FILTER (label = 'no')) / 2 AS threshold FROM s""")
def calibrate_threshold(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_tax").alias("score"), F.when(F.col("l_quantity") > 25, "yes").otherwise("no").alias("label"))
    return review.calibrate_threshold(df)


@query("""SELECT 'c_name' AS "column", 'company' AS normalizer, count(*) AS rows, count(*) FILTER (array_to_string(regexp_extract_all(lower(c_name), '[a-z0-9]+'), ' ') <> c_name) AS changed, 0::BIGINT AS failed FROM customer
 UNION ALL SELECT 'c_mktsegment', 'email', count(*), count(*) FILTER (lower(c_mktsegment) <> c_mktsegment), 0 FROM customer""")
def normalization_report(spark, sf):
    df = review.normalization_report(table(spark, sf, "customer"), {"c_name": "company", "c_mktsegment": "email"})
    return df.select("column", "normalizer", "rows", "changed", "failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
