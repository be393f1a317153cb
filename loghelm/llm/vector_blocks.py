"""Vectors dealt into bounded blocks, and every query sent to every block.

A search of a stated query set reads all rows in blocks of at most about BLOCK_BYTES of vectors.
Rows are shuffled once, to the task of their block, and never copied; what is copied to each
block are the queries. A task holds one block, with the index that is built of it once, and one
batch of queries, which come after the block's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
BLOCK_BYTES = 64 << 20


def usable(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool = True) -> DataFrame:
    """(vec_id long, v array<double>): rows with an id and a vector without null or non-finite
    components; empty vectors take no part."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)
    return out if allow_zero else out.where(F.exists("v", lambda x: x != 0))


def asked(rows: DataFrame, is_query: Column) -> DataFrame:
    """The queries among rows: an id that repeats asks once, with the smallest of its vectors."""
    return rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((dim, block), kind, ids, vectors) of each run of rows that share the first three."""
    dim, block, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    lists = batch.column(4)
    at = lists.offsets.to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    turns = np.nonzero((dim[1:] != dim[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
    cuts = [0, *turns.tolist(), len(dim)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield (int(dim[a]), int(block[a])), int(kind[a]), ids[a:b], flat[at[a] - at[0] : at[b] - at[0]].reshape(b - a, int(dim[a]))


def search(rows: DataFrame, queries: DataFrame, build: Callable, find: Callable, score: pa.DataType, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, vec_id, score) of what `find(index, query_id, query)` gives as (ids, scores), for
    each query and each block; `build(ids, vectors)` makes a block's index."""
    seen = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n = max(1, math.ceil(seen[0] / max(1, min(block_rows, BLOCK_BYTES // (8 * (seen[1] or 1))))))
    dim = F.size("v").alias("dim")
    own = rows.select(dim, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    sent = queries.select(dim, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    # more tasks than blocks, so that hardly a task gets two of them
    dealt = own.unionByName(sent).repartition(4 * n, "dim", "block").sortWithinPartitions("dim", "block", "kind")
    names = ("query_id", "vec_id", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, index = None, [], None
        for batch in batches:
            out = []
            for at, kind, ids, vectors in _runs(batch):
                if at != key:
                    key, parts, index = at, [], None
                if kind == 0:
                    parts.append((ids, vectors))
                    continue
                if not parts:  # no rows of this dimension in the block
                    continue
                if index is None:
                    index = build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                for query_id, q in zip(ids.tolist(), vectors, strict=True):
                    found, scores = find(index, query_id, q)
                    out.append((np.full(len(found), query_id, np.int64), found, scores))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], score)], names)

    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {'long' if score == pa.int64() else 'double'}")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: larger score first, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
