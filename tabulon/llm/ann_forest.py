"""Approximate nearest neighbours: a forest of sorted hash strings.

Each tree gives every vector one long string of bits (signs of random
projections) and keeps the strings as a sorted array. A query descends each tree
to its longest common prefix, and all trees then ascend together, one bit at a
time, until the rows under the prefixes, each counted once a tree, come to ``CROWD``
times the candidates wanted. Of the rows that were met, those that most trees brought
are the candidates, and these are scored exactly. Largest inner products become
largest cosines by one more component, sqrt(M^2 - |x|^2), with M the greatest norm of
a band: where norms are uneven that component would hide the rest, so the rows of a
shard are cut into bands of like norms, each with trees and candidates of its own.

The rows are dealt into shards of bounded size, each with its own forest, and
every block of queries meets every shard. With 35 % of a shard as candidates, at
every size of a shard, the recall on directionless 64-dimensional unit vectors,
the hardest case, is 0.94 in a shard of 500 rows, 0.98 of 2,000 and 0.998 of 16,384.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, clean, matrix, scatter_gather

#: Length of a hash string; rows that the trees bring, repeats counted, for each candidate.
BITS, CROWD = 40, 16
#: Greatest to least norm of a band; bands at most, of which the last takes all lesser norms.
LIKE, BANDS = 1.5, 10


class Forest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, x: np.ndarray, trees: int, seed: int, greatest: float):
        rng = np.random.default_rng(seed)
        self.n, self.dims = x.shape
        self.planes = rng.standard_normal((trees, self.dims + 1, BITS)).astype(np.float32)
        rest = np.sqrt(np.maximum(greatest**2 - np.einsum("ij,ij->i", x, x), 0))
        keys = [self._keys(np.column_stack([x, rest]).astype(np.float32), t) for t in range(trees)]
        self.order = np.array([np.argsort(k, kind="stable") for k in keys]).astype(np.int32)
        self.keys = np.array([k[o] for k, o in zip(keys, self.order, strict=True)])

    def _keys(self, x: np.ndarray, tree: int) -> np.ndarray:
        bits = (x @ self.planes[tree]) > 0
        return bits.astype(np.float64) @ (2.0 ** np.arange(BITS - 1, -1, -1))  # exact below 2^53

    def candidates(self, q: np.ndarray, wanted: int):
        """Yield (number of the query, rows) for each query."""
        x = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        trees = len(self.keys)
        keys = np.array([self._keys(x, t) for t in range(trees)]).astype(np.int64)
        own = self.keys.astype(np.int64)

        def under(depth: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Ends of the range that shares ``depth`` bits, per tree and query."""
            cut = BITS - depth
            low = (keys[:, who] >> cut) << cut
            lo = np.array([np.searchsorted(own[t], low[t], "left") for t in range(trees)])
            hi = np.array([np.searchsorted(own[t], low[t] + (1 << cut), "left") for t in range(trees)])
            return lo, hi

        # Descend: no prefix that is longer than the longest match of any tree has rows.
        open_ = np.arange(len(q))
        depth = min(BITS, int(np.ceil(np.log2(self.n + 1))) + 6)
        while len(open_):
            lo, hi = under(depth, open_)
            done = ((hi - lo).sum(axis=0) >= CROWD * wanted) | (depth == 0)
            for j in np.flatnonzero(done):
                met = np.concatenate([self.order[t, lo[t, j] : hi[t, j]] for t in range(trees)])
                votes = np.bincount(met, minlength=self.n)
                # Of equal votes the first rows win, so that reruns agree.
                yield open_[j], np.argsort(-votes, kind="stable")[:wanted]
            open_, depth = open_[~done], depth - 1  # ascend together


class Forests:
    """A forest for each band of like norms."""

    def __init__(self, x: np.ndarray, trees: int, seed: int):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        with np.errstate(divide="ignore"):  # norms too small for a double go to the last band
            band = np.minimum(np.log(norm.max() / norm) / np.log(LIKE), BANDS - 1).astype(int)
        self.rows = [np.flatnonzero(band == b) for b in np.unique(band)]
        self.forests = [Forest(x[at], trees, seed, float(norm[at].max())) for at in self.rows]

    def candidates(self, q: np.ndarray, share: float, least: int):
        """Yield (number of the query, rows): of each band ``share``, and ``least`` where it has as many."""
        found = [[] for _ in q]
        for at, forest in zip(self.rows, self.forests, strict=True):
            for j, own in forest.candidates(q, min(len(at), max(least, int(np.ceil(share * len(at)))))):
                found[j].append(np.packbits(np.isin(np.arange(len(at)), own, assume_unique=True)))
        for j, bits in enumerate(found):
            yield j, np.concatenate([at[np.unpackbits(b, count=len(at)).view(bool)] for at, b in zip(self.rows, bits, strict=True)])


def search_forest(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 20,
    trees: int = 128,
    share: float = 0.35,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found.

    Nearness is the inner product in double precision, ties go to the smaller
    id, and a query is never its own neighbour. ``is_query`` is a condition on
    the column ``id``. Candidates are ``share`` of each band of a shard's distinct
    vectors, alike at every size, but 4 * ``k`` where that is more, so that a query
    has its ``k``. Equal vectors of a shard are one candidate that brings all their
    ids. Columns of other names have no effect, of repeated rows one counts, and an
    empty table gives an empty result.
    """
    rows = clean(vectors, id_column, vector_column, drop_zero=True)
    n, n_queries, dims = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    schema = "query_id long, vec_id long, score double"

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x, q = a["id"].to_numpy(np.int64), matrix(a["v"], dims), matrix(b["v"], dims)
        query_ids = b["id"].to_numpy(np.int64)
        x, which = np.unique(x, axis=0, return_inverse=True)
        # Of equal vectors the k smallest ids count, and one more where the query is among them.
        order = np.argsort(which.ravel(), kind="stable")
        edges = np.searchsorted(which.ravel()[order], np.arange(len(x) + 1))
        own_ids = [ids[order[a:b]][: k + 1] for a, b in zip(edges, edges[1:], strict=False)]
        # Shape alone matters for candidates; scaled, no component is beyond single precision.
        near, look = x / np.abs(x).max(), q / np.abs(q).max(axis=1, keepdims=True)
        single = near.astype(np.float32)
        lengths = np.sqrt(np.einsum("ij,ij->i", near, near)).max() * np.sqrt(np.einsum("ij,ij->i", look, look))
        out = []
        for j, at in Forests(near, trees, seed).candidates(look, share, 4 * k):
            if len(at) > 4 * k:
                rough = single[at] @ look[j].astype(np.float32)
                edge = np.partition(rough, -k - 1)[-k - 1]
                # twice the bound on the rounding of sums in single precision: it can't hide one of the k best
                at = at[rough >= edge - (dims + 4) * 2.0**-22 * lengths[j]]
            score = np.repeat([np.dot(x[i], q[j]) for i in at], [len(own_ids[i]) for i in at])
            found = np.concatenate([own_ids[i] for i in at])
            other = found != query_ids[j]
            score, found = score[other], found[other]
            top = np.lexsort((found, -score))[:k]
            out.append((np.full(len(top), query_ids[j]), found[top], score[top]))
        cat = [np.concatenate(c) if out else np.array([]) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pd.DataFrame({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})

    found = scatter_gather(rows, rows.filter(is_query), n, n_queries, search, schema)
    return best(found, k, "double")
