"""Exact top-k search with a bit-sliced index.

Every component x becomes floor(scale * x). Within a row block, each dimension is shifted to
start at zero and cut into bit slices, one bitmap per bit. For a query, the slices are added
with weights by bitmap arithmetic alone (carry-save adders over the bitmaps of each binary
place; a negative weight adds the complement), which gives the bit slices of every row's
inner product. The top rows are then selected from the most significant slice downward, and
the rows that tie at the boundary are resolved exactly by vec_id.

Sums may be of any width: components beyond 62 bits are held as whole numbers without bound, and
slices are added place by place. Only a reported score must fit 64 bits; if one doesn't, the
search ends with an error that says so.

Defined cases: null, empty or non-finite vectors and null ids take no part. Vectors of another
dimension than the query's are no candidates. Rows that repeat an id are all candidates; such an
id asks once (smallest vector), and no row of its own id answers a query. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from loghelm.llm.vector_blocks import asked, best, search, usable

NARROW = float(1 << 62)


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as integers that cannot overflow."""
    if np.abs(values).max(initial=0) < NARROW / 2:
        return values.astype(np.int64)
    return np.asarray([int(x) for x in values.ravel()], object).reshape(values.shape)


class BitSlicedBlock:
    """Bit slices of an integer matrix: slices[d][b] is the bitmap of bit b of dimension d."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.n, self.dim = rows.shape
        self.low = rows.min(axis=0)
        lifted = (rows - self.low).T  # whole() leaves room for the difference
        self.bits = [int(x).bit_length() for x in lifted.max(axis=1)]
        words = -(-self.n // 64)
        self.valid = _bitmap(np.ones(self.n, bool), words)
        self.slices = [np.stack([_bitmap((lifted[d] >> b) & 1, words) for b in range(self.bits[d])]) if self.bits[d] else np.zeros((0, words), np.uint64) for d in range(self.dim)]
        self.inverse = [~s for s in self.slices]

    def weighted_sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of each row's sum, up to a constant per query."""
        places: dict[int, list[np.ndarray]] = {}
        for d in np.nonzero(weights)[0]:
            w = int(weights[d])
            own = self.slices[d] if w > 0 else self.inverse[d]
            w = abs(w)
            for shift in range(w.bit_length()):
                if w >> shift & 1:
                    for b in range(len(own)):
                        places.setdefault(shift + b, []).append(own[b])
        return _add(places, self.valid.shape[0])

    def top(self, weights: np.ndarray, k: int, ids: np.ndarray, own_id: int) -> np.ndarray:
        """Positions of the k rows with the largest sums, ties to the smaller id."""
        sums = self.weighted_sum(weights)
        left = self.valid.copy()
        own = np.nonzero(ids == own_id)[0]
        for i in own:
            left[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure = np.zeros_like(left)
        for s in reversed(sums):
            joined = sure | (left & s)
            n = int(np.bitwise_count(joined).sum())
            if n > k:
                left &= s
            else:
                sure = joined
                left &= ~s
                if n == k:
                    break
        found = _positions(sure, self.n)
        if len(found) < k:
            tied = _positions(left, self.n)
            found = np.concatenate([found, tied[np.argsort(ids[tied], kind="stable")[: k - len(found)]]])
        return found


def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    packed = np.packbits(bits.astype(np.uint8), bitorder="little")
    return np.pad(packed, (0, words * 8 - len(packed))).view(np.uint64)


def _positions(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])[0]


def _add(places: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Carry-save addition, all triples of a binary place at a time."""
    out: list[np.ndarray] = []
    top = max(places, default=-1)
    place = 0
    carried: list[np.ndarray] = []
    while place <= top or carried:
        here = [np.asarray(places[place])] if place in places else []
        here += carried
        stack = np.concatenate(here) if here else np.zeros((0, words), np.uint64)
        carried = []
        while len(stack) > 1:
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
                break
            m = len(stack) // 3
            x, y, z = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            half = x ^ y
            carried.append((x & y) | (half & z))
            stack = np.concatenate([half ^ z, stack[3 * m :]])
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        place += 1
    return out


def exact_scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, refused if one does not fit 64 bits."""
    out = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows]
    if any(not -(1 << 63) <= x < 1 << 63 for x in out):
        raise OverflowError("the inner product of a result does not fit 64 bits")
    return np.asarray(out, np.int64)


def bitsliced_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k rows of largest integer inner product.

    `is_query` is a condition on the column vec_id.
    """
    rows = usable(vectors, id_col, vec_col)

    def build(ids: np.ndarray, mat: np.ndarray) -> tuple:
        mat = whole(np.floor(mat * scale))
        return ids, mat, BitSlicedBlock(mat)

    def find(index: tuple, query_id: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, mat, sliced = index
        q = whole(np.floor(q * scale))
        at = sliced.top(q, k, ids, query_id)
        return ids[at], exact_scores(mat[at], q)

    return best(search(rows, asked(rows, is_query), build, find, pa.int64()), k)
