"""Exact top-k by inner product over vectors in descending order of length.

All rows are rotated onto the principal axes of the second-moment matrix of the
whole table, so that the first components carry most of a product. A shard is
read in descending order of norm, block by block: a block whose greatest norm
times the query's is below the query's k-th best can hold nothing, nor can any
later one. Within a block, partial sums over the first axes plus the
Cauchy-Schwarz bound on the rest leave few rows, which are scored in integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, clean, matrix, scatter_gather

#: Rows of a block of the scan; where the partial sums are cut (shares of the axes).
BLOCK, CUTS = 1024, (0.25, 0.5, 0.75)


def second_moment(rows: DataFrame, dims: int) -> np.ndarray:
    """Sum of x x^T over all rows; dims^2 numbers, whatever the number of rows."""

    def add(batches):
        total = np.zeros((dims, dims))
        for pdf in batches:
            x = matrix(pdf["v"], dims)
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dims), "row": list(total)})

    sums = rows.select("v").mapInPandas(add, "i int, row array<double>")
    cells = sums.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((dims, dims))
    for i, j, x in cells.collect():
        out[i, j] = x
    return out


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, turn: np.ndarray, k: int):
    """Yield (query's number, ids, scores) of the k best of each query, exact."""
    dims = x.shape[1]
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    order = np.argsort(-norms, kind="stable")
    x, ids, norms = x[order], ids[order], norms[order]
    rx, rq = x @ turn, q @ turn
    q_norms = np.sqrt(np.einsum("ij,ij->i", q, q))
    cuts = [0, *sorted({int(dims * c) for c in CUTS} - {0}), dims]
    tail = lambda m, c: np.sqrt(np.einsum("ij,ij->i", m[:, c:], m[:, c:]))
    x_tails, q_tails = [tail(rx, c) for c in cuts], [tail(rq, c) for c in cuts]
    whole_x, whole_q = x.astype(np.int64), q.astype(np.int64)
    held_id = [np.empty(0, np.int64) for _ in query_ids]
    held = [np.empty(0, np.int64) for _ in query_ids]
    bar = np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + norms.max(initial=0) * q_norms.max(initial=0))
    for start in range(0, len(x), BLOCK):
        block = slice(start, min(start + BLOCK, len(x)))
        live = np.flatnonzero(q_norms * norms[start] + slack >= bar)
        if not len(live):
            break
        part = np.zeros((len(live), block.stop - start))
        keep = np.ones(part.shape, bool)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part += rq[live, a:b] @ rx[block, a:b].T
            bound = part + np.outer(q_tails[i + 1][live], x_tails[i + 1][block]) + slack
            keep &= bound >= bar[live, None]
            left = keep.any(axis=1)
            if not left.all():
                part, keep, live = part[left], keep[left], live[left]
            if not len(live):
                break
        for r, j in enumerate(live):
            at = np.flatnonzero(keep[r]) + start
            at = at[ids[at] != query_ids[j]]
            if not len(at):
                continue
            score = np.concatenate([held[j], whole_x[at] @ whole_q[j]])
            who = np.concatenate([held_id[j], ids[at]])
            top = np.lexsort((who, -score))[:k]
            held[j], held_id[j] = score[top], who[top]
            if len(top) == k:
                bar[j] = max(bar[j], score[top[-1]])
    for j in range(len(q)):
        yield j, held_id[j], held[j]


def search_exact(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest integer products.

    A component x becomes floor(scale * x), x as a double. ``is_query`` is a
    condition on the column ``id``. Ties go to the smaller id; a query is never
    its own answer; an empty table gives an empty result. A zero vector takes
    part and scores 0. Of repeated rows one counts, and columns of other names
    have no effect. Vectors so long that a score might not fit 64 bits raise
    ValueError.
    """
    rows = clean(vectors, id_column, vector_column, drop_zero=False)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, n_queries, dims, most = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v")), F.max(square)).first()
    if (most or 0) >= 2.0**62:
        raise ValueError("Vectors are too long for scores of 64 bits; use a smaller scale.")
    dims = max(1, dims or 1)
    turn = np.linalg.eigh(second_moment(rows, dims))[1][:, ::-1].copy()
    schema = "query_id long, vec_id long, score long"

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        query_ids, out = b["id"].to_numpy(np.int64), []
        if len(a) and len(b):
            got = scan(matrix(a["v"], dims), a["id"].to_numpy(np.int64), matrix(b["v"], dims), query_ids, turn, k)
            out = [(np.full(len(s), query_ids[j]), i, s) for j, i, s in got if len(s)]
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        cat = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})

    found = scatter_gather(rows, rows.filter(is_query), n, n_queries, search, schema)
    return best(found, k, "long")
