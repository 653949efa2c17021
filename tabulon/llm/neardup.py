"""Near-duplicates by MinHash with tensored banding, and exact verification.

Two collections, A and B, of short MinHash bands are computed for each distinct
set of word shingles. A table key joins one band of A with one of B, so m + m
bands serve m * m tables: minhashes cost a square root of what separate tables
would need. Documents that share a key are candidates, and links hold only if
the full sets confirm them. The number of bands follows from the threshold, so
that a pair at the threshold shares no key with a probability below 1e-4.

What isn't shared can't be joined: a band that only one document has is dropped
before the pairs of bands are formed, which leaves few rows. Within a table's
bucket all documents are compared with the one of least id. Documents of buckets
that hold more than one component then meet by an exact way, a prefix filter over
their rarest shingles. Components come from rounds of joins on written tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, pick, spool
from .words import MIX, mixed, runs, shingle_sets

#: Minhashes of a band, and with which probability a pair at the threshold may be missed.
ROWS, MISSED = 3, 1e-4
#: Shingles hashed at once; shingles that a task compares with one document, about.
AT_ONCE, LOAD = 1024, 1 << 16
#: Up to so many rows of ids, tasks hold them all (some 30 bytes each).
FEW = 1_000_000
#: Rows of a key beyond which the key is joined apart from others.
HOT = 1000


def bands_for(percent: int) -> int:
    """Bands of each collection: a pair has to agree in one of A and in one of B."""
    differ = 1 - (percent / 100) ** ROWS
    return next(m for m in itertools.count(1) if 1 - (1 - differ**m) ** 2 < MISSED)


def minhash_bands(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of ROWS minhashes."""
    least, seeds = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64), seeds[:, None]
    for at in range(0, len(hashes), AT_ONCE):
        np.minimum(least, (seeds * hashes[None, at : at + AT_ONCE]).min(axis=1), out=least)
    out = np.arange(len(seeds) // ROWS, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * MIX + least[i::ROWS])
    return out


def sketches(docs: DataFrame, k: int, bands: int, seed: int = 8) -> DataFrame:
    """(row, doc_id, n_shingles, s1, s2, bands) of every whole text.

    s1 and s2 are 128 bits that stand for the set.
    """
    seeds = np.random.default_rng(seed).integers(1, 1 << 63, 2 * bands * ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, s1, s2, own = [], [], [], []
            for h in shingle_sets(as_text(pdf["text"]), k):
                whole = xxhash.xxh3_128_intdigest(h.tobytes())
                n.append(len(h))
                s1.append((whole >> 64) - (1 << 63))
                s2.append((whole & ((1 << 64) - 1)) - (1 << 63))
                own.append(minhash_bands(h, seeds).view(np.int64) if len(h) else np.empty(0, np.int64))
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": n, "s1": s1, "s2": s2, "bands": own})

    return docs.mapInPandas(run, "row long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """``rows`` joined to ``counted``, which says how many of ``rows`` each key has.

    A key of many rows would put them all into one task, so while such keys are
    counted to be few they are broadcast and their rows stay where they are.
    Beyond that the join is left to Spark, which splits skewed partitions. Both
    tables are read twice and should be written ones.
    """
    keys = [key] if isinstance(key, str) else key
    many = counted.filter(F.col(n) > HOT)
    size = many.count()
    if not size or size > FEW:
        return rows.join(counted, keys)
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(counted.filter(F.col(n) <= HOT), keys)
    return rest.unionByName(rows.join(F.broadcast(many), keys))


def bucket_rows(reps: DataFrame, bands: int) -> DataFrame:
    """(key, id, size, pivot, n): a row for each table of each set that may meet another there."""
    each = reps.select("id", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "h"))
    counts = spool(each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    shared = join_counted(each, counts, "h").groupBy("id", "size").agg(
        F.collect_list(F.when(F.col("band") < bands, F.col("h"))).alias("a"),
        F.collect_list(F.when(F.col("band") >= bands, F.col("h"))).alias("b"),
    )
    shared = spool(shared, "shared")
    keyed = shared.select("id", "size", F.explode("a").alias("x"), "b").select("id", "size", "x", F.explode("b").alias("y"))
    keyed = keyed.select(F.xxhash64("x", "y").alias("key"), "id", "size")
    more = spool(keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "tables")
    return join_counted(keyed, more, "key")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) of the written ``pairs``, by intersection and union of the full sets.

    ``pairs`` has (a, b) and the size of a's set. A document b that stands in many pairs gets
    copies, as many as the documents a beside it need, and copies and their
    pairs are dealt into bins of bounded size; so no text is sent once a pair,
    and no task has all pairs of one document.
    """
    spark = pairs.sparkSession
    loads = pairs.groupBy("b").agg(F.sum("size").alias("load"))
    loads = spool(loads.withColumn("copies", F.ceil(F.col("load") / LOAD).cast("long")), "loads")
    total = loads.agg(F.sum("load")).first()[0] or 0
    bins = F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LOAD)))
    heavy = loads.filter("copies > 1").select("b", "copies")
    heavy = F.broadcast(heavy) if heavy.count() <= FEW else heavy
    salted = pairs.join(heavy, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))))
    bin_ = F.pmod(F.xxhash64("b", "salt"), bins).alias("bin")
    left = salted.select("a", "b", bin_).join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    copies = loads.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    right = copies.select("b", bin_).join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(other["b"], shingle_sets(as_text(other["tb"]), k), strict=True))
        linked = []
        for p, b in zip(shingle_sets(as_text(own["ta"]), k), own["b"], strict=True):
            q = held[b]
            if min(len(p), len(q)) * 100 < percent * max(len(p), len(q)):
                linked.append(False)
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
        return pd.DataFrame({"a": own["a"], "b": own["b"], "linked": linked})

    return left.groupBy("bin").cogroup(right.withColumnRenamed("bin", "bin_b").groupBy("bin_b")).applyInPandas(run, "a long, b long, linked boolean")


def components(nodes_of: DataFrame, name: str) -> DataFrame:
    """(id, root) of every id in the links (a, b): the least id reachable.

    Alternating rounds: neighbours of a vertex are linked to its least
    neighbour, large ones first and then small ones, until nothing changes.
    The number of rounds grows with the logarithm of a component's size.
    """
    edges = nodes_of.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, last = spool(edges, f"{name}-0"), None
    for turn in itertools.count(1):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Only what a vertex is joined to that has larger neighbours; hubs have many.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        least = spool(least.filter("n > 0"), f"{name}-least-{turn}")
        large = join_counted(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), least, "u")
        large = spool(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large-{turn}")
        # Here a vertex is the larger end: it has as many rows as it has smaller neighbours.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(lower, "u")
        small = pairs.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = spool(small.filter("u <> v").distinct(), f"{name}-{turn}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def unresolved(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of the documents whose bucket holds more than one component.

    In a bucket of two the one pair has been compared already.
    """
    rooted = spool(rows.filter("n > 2").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "rooted")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    open_ = spool(open_.filter("lo < hi").select("key", "n"), "open")
    return join_counted(rooted, open_, "key").select("id", "root").distinct()


def prefix_pairs(texts: DataFrame, k: int, percent: int, block: int = 512) -> DataFrame:
    """(a, b, size of a) among ``texts`` (id, root, text) that may be linked across components.

    The exact way beyond buckets: sets of similarity t share one of the
    n - ceil(t * n) + 1 shingles that are rarest among these documents. What a
    copy has of its own is rarest, so copies that drifted apart share none of
    those and make no pair. The documents of a shingle meet in blocks, and only
    pairs of different components go on whose sizes and whose places of the
    shingle leave room for the intersection they need.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = as_text(pdf["text"])
            for at in runs(texts):
                part, own = pdf.iloc[at], list(shingle_sets(texts[at], k))
                n = np.array([len(h) for h in own])
                if n.sum():
                    col = lambda c: np.repeat(part[c].to_numpy(), n)  # noqa: B023, E731
                    yield pd.DataFrame({"id": col("id"), "root": col("root"), "n": np.repeat(n, n), "h": np.concatenate(own).view(np.int64)})

    each = spool(texts.mapInPandas(cut, "id long, root long, n long, h long"), "shingles")
    met = each.groupBy("h").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = join_counted(each, spool(met.filter("df > 1"), "shared"), "h", "df").groupBy("id").agg(
        F.first("root").alias("root"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h", (F.col("lo") < F.col("hi")).alias("x")))).alias("s")
    )
    # Shingles of one document alone come first and take up the prefix.
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    left = F.greatest(F.lit(0), F.col("n").cast("int") - need + 1 - (F.col("n").cast("int") - F.size("s")))
    own_only = (F.col("n").cast("int") - F.size("s")).alias("u")
    keyed = shared.filter(left > 0).select("id", "root", "n", own_only, F.posexplode(F.slice("s", F.lit(1), left)).alias("p", "t"))
    rest = F.col("n") - F.col("u") - F.col("p")  # shingles from this one on, in the common order
    keyed = spool(keyed.filter("t.x").select(F.col("t.h").alias("key"), "id", "root", "n", rest.alias("rest")), "prefixes")
    # Even with the least set that has the shingle, a document needs so much of its own.
    met = lambda rows: rows.groupBy("key").agg(
        F.count("*").alias("df"), F.min("n").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi")
    ).filter("lo < hi")
    enough = (100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("least"))
    least = spool(met(keyed).select("key", "df", "least"), "least")
    keyed = spool(join_counted(keyed, least, "key", "df").filter(enough).drop("df", "least"), "enough")
    keyed = join_counted(keyed, spool(met(keyed).select("key", "df"), "blocks"), "key", "df")
    blocks = F.ceil(F.col("df") / block).cast("int")
    at = keyed.withColumn("own", F.pmod(F.xxhash64("id", "key"), blocks).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    at = at.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "n", "rest")
    several = at.groupBy("key", "i", "j").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "i", "j")
    at = at.join(several, ["key", "i", "j"])

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[1]), int(key[2])
        x, y = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        a, ra, n, r, b, rb, m, s = (d[c].to_numpy() for d in (x, y) for c in ("id", "root", "n", "rest"))
        near = (ra[:, None] != rb[None]) & (100 * np.minimum(n[:, None], m[None]) >= percent * np.maximum(n[:, None], m[None]))
        # From the first shared shingle on, both have to hold the whole intersection.
        near &= (100 + percent) * np.minimum(r[:, None], s[None]) >= percent * (n[:, None] + m[None])
        p, q = np.nonzero(near if i != j else np.triu(near, 1))
        return pd.DataFrame({"a": np.maximum(a[p], b[q]), "b": np.minimum(a[p], b[q]), "size": np.where(a[p] > b[q], n[p], m[q])})

    return at.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long, size long").distinct()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as written once, and a key ``_row`` of each row."""
    return spool(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python so many at once; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def find_groups(docs: DataFrame, k: int, percent: int, bands: int | None) -> DataFrame:
    """``groups`` with small batches; all of its Python runs before it returns."""
    with small_batches(docs.sparkSession):
        return groups(docs, k, percent, bands)


def groups(docs: DataFrame, k: int, percent: int, bands: int | None) -> DataFrame:
    """(row, doc_id, n_shingles, lead) of every row of ``docs`` (row, doc_id, text).

    lead is the struct (no_id, doc_id, row) of the component's first row: that of
    the least doc_id, and of the least row where none has an id. It is null for
    documents without words. Sets are known by rows, whatever their ids.
    """
    bands = bands or bands_for(percent)
    all_ = spool(sketches(docs, k, bands), "sketches")
    # One set for all rows that have it.
    sets = all_.filter("n_shingles > 0").groupBy("s1", "s2")
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    reps = spool(sets.agg(F.min("row").alias("id"), F.min(lead).alias("lead"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "sets")
    rows = spool(bucket_rows(reps.select("id", "n_shingles", "bands"), bands), "buckets")
    first = spool(rows.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"), "size").distinct(), "pairs")
    named = docs.select(F.col("row").alias("id"), "text")

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        ids = F.broadcast(ids) if ids.count() <= FEW else ids
        return named.join(ids, "id", "left_semi")

    checked = spool(verify(first, texts_of(first), k, percent), "verified")
    links = checked.filter("linked")
    roots = components(links, "roots")
    open_ = spool(unresolved(rows, roots), "unresolved")
    n_open = open_.count()
    if n_open:
        few = F.broadcast(open_) if n_open <= FEW else open_
        texts = named.join(few, "id")
        rest = prefix_pairs(texts, k, percent).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        rest = spool(rest, "residual")
        more = spool(verify(rest, texts_of(rest), k, percent).filter("linked"), "verified-rest")
        if not more.isEmpty():
            star = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
            roots = components(star.unionByName(more.select("a", "b")), "all-roots")
    rooted = spool(reps.join(roots, "id", "left").select("s1", "s2", "rows", "lead", F.coalesce("root", "id").alias("root")), "rooted-sets")
    leads = spool(rooted.groupBy("root").agg(F.min("lead").alias("lead"), F.count("*").alias("n")), "leads")
    found = spool(join_counted(rooted.drop("lead"), leads, "root").select("s1", "s2", "rows", "lead"), "led")
    own = all_.select("row", "doc_id", "n_shingles", "s1", "s2")
    led = join_counted(own.filter("n_shingles > 0"), found, ["s1", "s2"], "rows").select("row", "doc_id", "n_shingles", "lead")
    none = own.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.lit(None).cast(found.schema["lead"].dataType).alias("lead"))
    return led.unionByName(none)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two documents are linked if 100 * intersection >= percent * union of their
    distinct k-word shingles; component_id is the least doc_id reachable by
    links, and the row that has it is kept. Documents without words are linked
    with nothing. Rows of equal sets are linked without a comparison. A null
    doc_id is reached by links but names no component: of such rows one is kept
    if no row with an id is in its component.
    """
    rows = numbered(pick(docs, "doc_id", "text")).withColumnRenamed("_row", "row")
    found = find_groups(rows, k, percent, bands)
    component = F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    own = F.when(F.col("lead.no_id"), F.col("row") == F.col("lead.row"))
    kept = F.coalesce(own, F.col("doc_id").eqNullSafe(component))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, bands: int | None = None) -> DataFrame:
    """One row, all columns, of each component that ``near_duplicates`` finds.

    Rows go by their own keys, never by a doc_id that they share with others.
    The keys that go are found first; only those are joined, broadcast while they
    are few. Of rows without words one stays for each doc_id, and all without it.
    """
    names = docs.columns
    own = numbered(docs.toDF(*(f"_c{i}" for i in range(len(names)))))
    at = lambda name: F.col(f"_c{names.index(name)}")
    rows = own.select(F.col("_row").alias("row"), at("doc_id").cast("long").alias("doc_id"), at("text").alias("text"))
    found = spool(find_groups(rows, k, percent, bands), "found")
    gone = found.filter("lead.row <> row").select("row")
    wordless = found.filter("lead is null and doc_id is not null")
    again = wordless.join(wordless.groupBy("doc_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1"), "doc_id")
    gone = spool(gone.unionAll(again.filter("row <> first").select("row")).select(F.col("row").alias("_row")), "gone")
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return own.join(gone, "_row", "left_anti").drop("_row").toDF(*names)
