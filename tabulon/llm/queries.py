"""The ten operators as queries over the tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bloom_lm, common, mixing, neardup, packing, pii, quality, token_output, topk, toxicity

TOKENIZER = "word_bpe_49k.json"


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return ann_forest.search_forest(vectors, F.col("id") % 20 == 0, k=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, labels, common.remainder("id", 5) != 0)
    held, hit = common.remainder("doc_id", 5) == 0, F.col("score") >= 0.5
    return scored.select("doc_id", held.alias("held_out"), "score", hit.cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(common.table(spark, sf_dir, "documents"))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.search_exact(vectors, F.col("id") % 50 == 0, k=5, scale=256.0)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_output.write_tokens(common.table(spark, sf_dir, "documents"), path, tokenizer())
    return token_output.read_tokens(spark, path)


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_texts(common.table(spark, sf_dir, "documents"), mod=7, rest=2)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels, common.remainder("id", 4) != 2)
    held, hit = common.remainder("doc_id", 4) == 2, F.col("score") >= 0.7
    return scored.select("doc_id", held.alias("held_out"), "score", hit.cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_ann_forest, op2_toxicity, op3_pii, op4_mixing, op5_topk, op6_token_output, op7_bloom_lm, op8_neardup, op9_quality, op10_packing]
    return {f.__name__: f for f in [*own, pipeline]}


#: SQL where it can express a result exactly and is fast on whole tables.
ORACLE_SQL = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_neardup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), e AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * shared >= 85 * (x.n + y.n - shared)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
        ), c AS (
            SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
