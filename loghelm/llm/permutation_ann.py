"""Approximate nearest neighbours with a permutation index.

A bounded sample of vectors gives the pivots. Every vector is represented by the order of its
`kept` nearest pivots and posted, with its place, in the inverted file of each of them. A query
visits the inverted files of its own nearest pivots only, which yields the footrule distance
between the two (cut) orders of every row met there; the closest rows by footrule, a `share` of
all, are reranked by the exact inner product in double precision.

The inverted files are kept per block of at most BLOCK_ROWS vectors, so that a pivot near a
third of all rows makes no long list, and the share of rows reranked is the same in each block
and at any size. Every row is indexed; only the pivots come from a sample of PIVOT_SAMPLE vectors.

Defined cases: null, empty, zero or non-finite vectors and null ids take no part; rows that repeat
an id are all candidates; such an id asks once (smallest vector), and no row of its own id
answers a query; ties by footrule at the candidate boundary are all reranked; ties by score go to
the smaller vec_id; a dimension of which the sample has no vector is searched exactly; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghelm.llm.vector_blocks import BLOCK_ROWS, asked, best, search, usable

PIVOT_SAMPLE = 4096


def choose_pivots(rows: DataFrame, n_pivots: int, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """Unit pivots per dimension, spread out by farthest-first choice in the sample.

    The sample is the `sample` vectors with the smallest hash of id.
    """
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in got:
        by_dim.setdefault(len(r.v), []).append(r.v)
    out = {}
    for dim, vs in by_dim.items():
        x = np.unique(np.asarray(vs, np.float64), axis=0)
        with np.errstate(all="ignore"):
            x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng(7)
        chosen = [int(rng.integers(len(x)))]
        closest = x @ x[chosen[0]]
        while len(chosen) < min(n_pivots, len(x)):
            # the farthest of a random few: spread out, yet not only outliers
            few = rng.integers(len(x), size=8)
            nxt = int(few[np.argmin(closest[few])])
            chosen.append(nxt)
            closest = np.maximum(closest, x @ x[nxt])
        out[dim] = x[np.unique(chosen)]
    return out


def positions(mat: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """order[i, j]: the pivot at place j of row i's order, nearest first."""
    with np.errstate(all="ignore"):
        unit = mat / np.abs(mat).max(axis=1, keepdims=True)
    sims = unit @ pivots.T
    return np.argsort(-sims, axis=1, kind="stable")[:, :kept]


class InvertedFiles:
    """For each pivot, the rows of a block that have it in their order, and how near it is to each:
    `kept` less its place. The files lie one after the other; `starts` tells where each begins."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.n, self.kept = order.shape
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.rows = (by_pivot // self.kept).astype(np.int32)
        self.near = (self.kept - by_pivot % self.kept).astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(order.ravel(), minlength=n_pivots))])

    def footrule(self, own: np.ndarray) -> np.ndarray:
        """Footrule distance to each row; a pivot missing from an order stands at place `kept`.

        |a - b| = (k - a) + (k - b) - 2 min(k - a, k - b): the first two sums are the same for
        all rows, and the files of the query's own pivots give the third.
        """
        files = [slice(self.starts[p], self.starts[p + 1]) for p in own]
        rows = np.concatenate([self.rows[f] for f in files])
        shared = np.concatenate([np.minimum(self.near[f], self.kept - place) for place, f in enumerate(files)])
        met = np.bincount(rows, weights=shared, minlength=self.n)
        return self.kept * (self.kept + 1) - 2 * met.astype(np.int64)


def permutation_ann(vectors: DataFrame, is_query: Column, k: int = 20, n_pivots: int = 256, kept: int = 64, share: float = 0.25, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found, by largest inner product.

    `share` of each block is reranked. `is_query` is a condition on the column vec_id.
    """
    rows = usable(vectors, id_col, vec_col, allow_zero=False)
    pivots = choose_pivots(rows, n_pivots)

    def build(ids: np.ndarray, mat: np.ndarray) -> tuple:
        own = pivots.get(mat.shape[1])
        return ids, mat, own, None if own is None else InvertedFiles(positions(mat, own, kept), len(own))

    def find(index: tuple, query_id: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, mat, own, files = index
        n_c = max(k + 1, math.ceil(share * len(ids)))
        at = np.arange(len(ids))
        if files is not None and n_c < len(ids):
            apart = files.footrule(positions(q[None], own, kept)[0])
            at = np.nonzero(apart <= np.partition(apart, n_c - 1)[n_c - 1])[0]
        at = at[ids[at] != query_id]
        score = np.einsum("ij,j->i", mat[at], q)
        first = np.lexsort((ids[at], -score))[:k]
        return ids[at[first]], score[first]

    return best(search(rows, asked(rows, is_query), build, find, pa.float64(), block_rows), k)
