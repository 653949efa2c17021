"""Further review steps: normalizers, typed scorers, cluster scores, calibration."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import float_of, fold, moment_of, rounded, strip, text, tokens
from ..sources.readers import require_columns
from .duplicates import levenshtein
from .profile import frequencies, leading

# Legal forms of companies, and short forms in addresses.
COMPANY_FORMS = "inc incorporated corp corporation co company llc ltd limited plc gmbh ag sa srl bv nv pty lp llp".split()
ADDRESS_FORMS = {"street": "st", "avenue": "ave", "road": "rd", "boulevard": "blvd", "drive": "dr", "lane": "ln", "suite": "ste", "apartment": "apt", "north": "n", "south": "s", "east": "e", "west": "w"}


def universal(c: Column) -> Column:
    return F.regexp_replace(strip(fold(c)), r"\s+", " ")


def person(c: Column) -> Column:
    """Folded tokens without titles and suffixes; ``Last, First`` becomes ``First Last``."""
    drop = ["mr", "mrs", "ms", "dr", "prof", "jr", "sr", "ii", "iii"]
    plain = lambda x: F.filter(tokens(fold(x)), lambda t: ~t.isin(drop))
    last, first = plain(F.substring_index(c, ",", 1)), plain(F.regexp_replace(c, "^[^,]*,?", ""))
    return F.array_join(F.when(F.size(first) > 0, F.concat(first, last)).otherwise(last), " ")


def company(c: Column) -> Column:
    """Folded tokens without legal forms; an ampersand is ``and``."""
    return F.array_join(F.filter(tokens(fold(F.replace(c, F.lit("&"), F.lit(" and ")))), lambda t: ~t.isin(COMPANY_FORMS)), " ")


def address(c: Column) -> Column:
    """Folded tokens with abbreviations and directions written out."""
    long = F.create_map(*(F.lit(x) for kv in ADDRESS_FORMS.items() for x in reversed(kv)))
    return F.array_join(F.transform(tokens(fold(c)), lambda t: F.coalesce(F.try_element_at(long, t), t)), " ")


def phone(c: Column) -> Column:
    """Digits, with a plus sign that comes before all of them."""
    return F.concat(F.when(c.rlike(r"^\D*\+\D*\d"), "+").otherwise(""), F.regexp_replace(c, r"\D", ""))


def date(c: Column) -> Column:
    return F.coalesce(F.date_format(moment_of(c), "yyyy-MM-dd"), F.lit(""))


def email(c: Column) -> Column:
    """Lower case, without ``mailto:``, and without dots in the local part of Gmail addresses."""
    c = F.regexp_replace(F.lower(strip(c)), "^mailto:", "")
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    return F.when(c.rlike("@(?:gmail|googlemail)[.]com$"), F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@"), domain)).otherwise(c)


NORMALIZERS = {"universal": universal, "person": person, "company": company, "address": address, "phone": phone, "date": date, "email": email}


def normalization_report(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, normalizer, rows, changed, failed, samples) for {column: normalizer}."""
    require_columns(df, *kinds)
    freq = frequencies(df, list(kinds))
    new = F.coalesce(*(F.when(F.col("column") == c, NORMALIZERS[k](F.col("value"))) for c, k in kinds.items()))
    at = freq.withColumn("new", new)
    n, changed = F.col("n"), F.col("new") != F.col("value")
    failed = (F.col("new") == "") & (F.col("value") != "")
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    out = at.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(changed, n).otherwise(0)).alias("changed"), F.sum(F.when(failed, n).otherwise(0)).alias("failed"))
    sample = F.array_sort(F.collect_list(F.struct("place", "value", "new"))).alias("s")
    out = out.join(leading(at.filter(changed), 3, ["first_pos"], "column").groupBy("column").agg(sample), "column", "left")
    pairs = F.transform(F.coalesce("s", F.array().cast("array<struct<place:int,value:string,new:string>>")), lambda s: F.struct(s["value"].alias("before"), s["new"].alias("after")))
    return out.select("column", kind[F.col("column")].alias("normalizer"), "rows", "changed", "failed", pairs.alias("samples")).orderBy("column")


def extended_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Lengths, leading zeros, repeats, business suffixes and sample values of columns."""
    freq = frequencies(df, columns)
    v, n = F.col("value"), F.col("n")
    filled = v != ""
    forms = F.size(F.filter(tokens(fold(v)), lambda t: t.isin(COMPANY_FORMS))) > 0
    count = lambda c: F.sum(F.when(c, n).otherwise(0)).cast("long")
    first = leading(freq.filter(filled), 5, ["first_pos"], "column").groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
    length = F.when(filled, F.length(v))
    out = freq.groupBy("column").agg(
        F.min(length).alias("min_length"), F.max(length).alias("max_length"),
        rounded(F.sum(length * n) / F.sum(F.when(filled, n))).alias("mean_length"), count(v.rlike("^0[0-9]")).alias("leading_zeros"),
        count(filled & (n > 1)).alias("repeated_rows"), count(forms).alias("business_suffixes"),
    )
    samples = F.coalesce(F.transform("s", lambda s: s["value"]), F.array().cast("array<string>"))
    return out.join(first, "column", "left").withColumn("samples", samples).drop("s").orderBy("column")


def validate_types(profile: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns of a profile whose inferred type isn't the expected one, or that parse badly."""
    kind = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    want = kind[F.col("column")]
    rate = F.when(want.isin("numeric", "currency"), F.col("numeric_parse_rate")).when(want == "datetime", F.col("datetime_parse_rate")).otherwise(1.0)
    out = profile.filter(F.col("column").isin(*expected)).select("column", want.alias("expected"), "inferred_type", rate.alias("parse_rate"), "invalid_examples")
    return out.filter((F.col("expected") != F.col("inferred_type")) | (F.col("parse_rate") < 1))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Levenshtein ratio of the values as they stand, tokens unsorted."""
    return levenshtein(a, b)


def email_composite(a: Column, b: Column) -> Column:
    """Half for the domain, half for the ratio of local parts; another domain allows 0.5 at most, a blank 0."""
    a, b = email(a), email(b)
    local = fuzzy_ratio(F.substring_index(a, "@", 1), F.substring_index(b, "@", 1))
    same = F.substring_index(a, "@", -1) == F.substring_index(b, "@", -1)
    blank = F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin("")
    return F.when(blank, 0.0).when(same, 0.5 + 0.5 * local).otherwise(F.least(F.lit(0.5), 0.5 * local))


def exact(a: Column, b: Column) -> Column:
    return (strip(a) == strip(b)).cast("double")


def exact_normalized(a: Column, b: Column) -> Column:
    return (phone(a) == phone(b)).cast("double")


def exact_parsed(a: Column, b: Column, days: int = 0) -> Column:
    apart = F.abs(F.date_diff(moment_of(a).cast("date"), moment_of(b).cast("date")))
    return F.coalesce((apart <= days).cast("double"), F.lit(0.0))


def normalized_distance(a: Column, b: Column, low: Column, high: Column) -> Column:
    x, y, span = float_of(a), float_of(b), high - low
    return F.coalesce(F.when(span == 0, 1.0).otherwise(1 - F.abs(x - y) / span), F.lit(0.0))


#: Scorers that compare a form of each value for equality: the form is made once a row.
FORMS = {exact: strip, exact_normalized: phone}


def scored_rows(df: DataFrame, cluster_column: str, id_column: str, scorers: dict) -> DataFrame:
    """(cluster_id, id, v0, v1, ...): the form of each value that its scorer compares; rows of a blank cluster take no part."""
    require_columns(df, cluster_column, id_column, *scorers)
    rows = df.select(text(df, cluster_column).alias("cluster_id"), text(df, id_column).alias("id"), *(FORMS.get(f, lambda v: v)(text(df, c)).alias(f"v{i}") for i, (c, f) in enumerate(scorers.items())))
    return rows.filter("cluster_id <> ''")


def cluster_pairs(df: DataFrame, cluster_column: str, id_column: str, scorers: dict) -> DataFrame:
    """(cluster_id, id, id2, s0, s1, ...) of all pairs of a cluster's rows with different ids."""
    rows = scored_rows(df, cluster_column, id_column, scorers)
    same = lambda a, b: (a == b).cast("double")
    other = rows.select("cluster_id", F.col("id").alias("id2"), *(F.col(f"v{i}").alias(f"w{i}") for i in range(len(scorers))))
    pairs = rows.join(other, "cluster_id").filter("id < id2")
    return pairs.select("cluster_id", "id", "id2", *((same if f in FORMS else f)(F.col(f"v{i}"), F.col(f"w{i}")).alias(f"s{i}") for i, f in enumerate(scorers.values())))


def counted(scorers: dict) -> bool:
    """Whether values count for equality only: then pairs are counted, not made."""
    return all(f in FORMS for f in scorers.values())


def value_counts(df: DataFrame, cluster_column: str, id_column: str, scorers: dict) -> DataFrame:
    """(cluster_id, id, i, v, n): how many rows of an id hold the form v in column i.

    After the columns comes one that is equal on every row: its equal pairs are all pairs.
    """
    rows = scored_rows(df, cluster_column, id_column, scorers)
    values = F.array(*(F.col(f"v{i}") for i in range(len(scorers))), F.lit(""))
    return rows.select("cluster_id", "id", F.posexplode(values).alias("i", "v")).groupBy("cluster_id", "id", "i", "v").agg(F.count("*").alias("n"))


def equal_pairs(df: DataFrame, cluster_column: str, id_column: str, scorers: dict) -> DataFrame:
    """(cluster_id, k, e0, e1, ...): a cluster's pairs with different ids, and those equal in each column, every pair twice.

    A form in h rows, n of them of one id, has h * h - sum(n * n) such pairs.
    """
    held = value_counts(df, cluster_column, id_column, scorers).groupBy("cluster_id", "i", "v").agg(F.sum("n").alias("h"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return by_column(held, ["cluster_id"], F.col("h") * F.col("h") - F.col("q"), len(scorers))


def by_column(counts: DataFrame, keys: list[str], n: Column, width: int) -> DataFrame:
    """(keys, k, e0, e1, ...): sums of ``n`` by column; keys without a pair are left out."""
    total = lambda i: F.sum(F.when(F.col("i") == i, n).otherwise(0))
    return counts.groupBy(*keys).agg(total(width).alias("k"), *(total(i).alias(f"e{i}") for i in range(width))).filter("k > 0")


def record_sums(df: DataFrame, cluster_column: str, id_column: str, scorers: dict) -> DataFrame:
    """(cluster_id, record_id, record_score, t, k): mean and sum of the scores of a record's pairs, and their number."""
    width = len(scorers)
    if counted(scorers):
        cells = value_counts(df, cluster_column, id_column, scorers)
        held = cells.groupBy("cluster_id", "i", "v").agg(F.sum("n").alias("h"))
        sums = by_column(cells.join(held, ["cluster_id", "i", "v"]), ["cluster_id", "id"], F.col("n") * (F.col("h") - F.col("n")), width)
        equal = functools.reduce(operator.add, [F.col(f"e{i}") for i in range(width)])
        return sums.select("cluster_id", F.col("id").alias("record_id"), (equal / width / F.col("k")).alias("record_score"), (equal / width).alias("t"), "k")
    mean = functools.reduce(operator.add, [F.col(f"s{i}") for i in range(width)]) / width
    scored = cluster_pairs(df, cluster_column, id_column, scorers).select("cluster_id", F.explode(F.array("id", "id2")).alias("record_id"), mean.alias("s"))
    return scored.groupBy("cluster_id", "record_id").agg(F.avg("s").alias("record_score"), F.sum("s").alias("t"), F.count("*").alias("k"))


def within_cluster_scores(df: DataFrame, cluster_column: str, id_column: str, scorers: dict) -> DataFrame:
    """(cluster_id, record_id, record_score, cluster_score): means over the pairs of a cluster.

    ``scorers`` maps columns to (Column, Column) -> Column.
    """
    record = record_sums(df, cluster_column, id_column, scorers)
    cluster = record.groupBy("cluster_id").agg((F.sum("t") / F.sum("k")).alias("cluster_score"))
    return record.join(cluster, "cluster_id").select("cluster_id", "record_id", "record_score", "cluster_score").orderBy("cluster_id", "record_id")


def field_scores(df: DataFrame, cluster_column: str, id_column: str, scorers: dict) -> DataFrame:
    """(cluster_id, field, mean_score): each field's mean over the pairs of a cluster."""
    if counted(scorers):
        means = equal_pairs(df, cluster_column, id_column, scorers).select("cluster_id", *((F.col(f"e{i}") / F.col("k")).alias(f"m{i}") for i in range(len(scorers))))
    else:
        means = cluster_pairs(df, cluster_column, id_column, scorers).groupBy("cluster_id").agg(*(F.avg(f"s{i}").alias(f"m{i}") for i in range(len(scorers))))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"m{i}").alias("mean_score")) for i, c in enumerate(scorers)))
    return means.select("cluster_id", F.inline(each)).orderBy("cluster_id", "field")


def pair_scores(df: DataFrame, cluster_column: str, id_column: str, column: str, scorer) -> DataFrame:
    """(cluster_id, score, n): how many pairs of a cluster have each score of one column."""
    given = df, cluster_column, id_column, {column: scorer}
    if not counted({column: scorer}):
        return cluster_pairs(*given).groupBy("cluster_id", F.col("s0").alias("score")).agg(F.count("*").alias("n"))
    half = lambda n: F.shiftright(n, 1)
    each = F.array(*(F.struct(F.lit(s).alias("score"), half(n).alias("n")) for s, n in ((1.0, F.col("e0")), (0.0, F.col("k") - F.col("e0")))))
    return equal_pairs(*given).select("cluster_id", F.inline(each)).filter("n > 0")


def ranked_pairs(pairs: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """``pairs`` whose score reaches the calibrated threshold, best first, with all their columns."""
    return pairs.filter(F.col(score) >= threshold).orderBy(F.desc(score), *(c for c in pairs.columns if c not in (score, "column_scores")))


def pair_quality_summary(pairs: DataFrame, block: str = "block_value", score: str = "score", high: float = 0.9, medium: float = 0.7) -> DataFrame:
    """(measure, name, value): pairs at each level of confidence and of each block."""
    level = F.when(F.col(score) >= high, "high").when(F.col(score) >= medium, "medium").otherwise("low")
    count = lambda measure, c: pairs.groupBy(c.cast("string").alias("name")).agg(F.count("*").alias("value")).select(F.lit(measure).alias("measure"), "name", "value")
    return count("confidence", level).unionByName(count("block", F.col(block))).orderBy("measure", "name")


def flagged_clusters(scores: DataFrame, low: float = 0.8) -> DataFrame:
    """Clusters above the mean size whose score is below ``low``."""
    size = scores.groupBy("cluster_id").agg(F.count("*").alias("size"), F.first("cluster_score").alias("cluster_score"))
    mean = size.agg(F.avg("size").alias("mean_size"))  # one row
    return size.join(F.broadcast(mean)).filter((F.col("size") > F.col("mean_size")) & (F.col("cluster_score") < low)).select("cluster_id", "size", "cluster_score").orderBy(F.desc("size"), "cluster_id")


def cross_cluster_collisions(df: DataFrame, cluster_column: str, column: str) -> DataFrame:
    """Values that more than one cluster holds, with those clusters."""
    require_columns(df, cluster_column, column)
    pairs = df.select(text(df, column).alias("value"), text(df, cluster_column).alias("c")).filter("value <> '' and c <> ''").distinct()
    out = pairs.groupBy("value").agg(F.array_sort(F.collect_list("c")).alias("clusters"))
    return out.filter(F.size("clusters") > 1).select("value", F.size("clusters").cast("long").alias("cluster_count"), "clusters").orderBy(F.desc("cluster_count"), "value")


def calibrate_threshold(labelled: DataFrame, score: str = "score", label: str = "label", default: float = 0.7) -> DataFrame:
    """One row: halfway between the lowest score of a yes and the highest of a no."""
    yes, no = F.min(F.when(F.col(label) == "yes", F.col(score))), F.max(F.when(F.col(label) == "no", F.col(score)))
    return labelled.agg(yes.alias("lowest_yes"), no.alias("highest_no")).withColumn("threshold", F.coalesce((F.col("lowest_yes") + F.col("highest_no")) / 2, F.lit(default)))


def sanity_checks(cluster_scores: DataFrame, fields: DataFrame | None = None, pairs: DataFrame | None = None, low: float = 0.8, threshold: float = 0.7, repeats: str | None = None) -> DataFrame:
    """(check, value, triggered): signs that a review as a whole went wrong.

    From (cluster_id, cluster_score): the share of clusters below ``low`` above
    0.9, the greatest score at most 0.05, the least at least 0.95. From
    (field, mean_score): a field whose mean is 0.3 or more below that of the
    others. From unclustered ``pairs`` with a score: more than half of them at
    ``threshold`` or above; a row of ``pairs`` counts as often as its column
    ``repeats`` says, else once. Without rows a check is not triggered.
    """
    each = cluster_scores.select("cluster_id", "cluster_score").distinct()
    share = lambda c: F.avg(c.cast("double"))
    top = each.agg(share(F.col("cluster_score") < low).alias("a"), F.max("cluster_score").alias("b"), F.min("cluster_score").alias("c"))
    rows = lambda df, *checks: df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(v).alias("value"), F.coalesce(t, F.lit(False)).alias("triggered")) for n, v, t in checks))))
    out = rows(top, ("most_clusters_flagged", "a", F.col("a") > 0.9), ("scores_near_zero", "b", F.col("b") <= 0.05), ("scores_near_one", "c", F.col("c") >= 0.95))
    if fields is not None:
        means = fields.groupBy("field").agg(F.avg("mean_score").alias("m"))
        gap = means.agg(F.min("m").alias("low"), F.sum("m").alias("sum"), F.count("*").alias("n"))
        gap = gap.select(F.when(F.col("n") > 1, (F.col("sum") - F.col("low")) / (F.col("n") - 1) - F.col("low")).alias("d"))
        out = out.unionByName(rows(gap, ("low_field", "d", F.col("d") >= 0.3)))
    if pairs is not None:
        match, n = F.col("score") >= threshold, F.col(repeats) if repeats else F.lit(1)
        part = F.try_divide(F.sum(F.when(match, n).otherwise(0)), F.sum(F.when(match.isNotNull(), n)))
        out = out.unionByName(rows(pairs.agg(part.alias("p")), ("most_pairs_match", "p", F.col("p") > 0.5)))
    return out
