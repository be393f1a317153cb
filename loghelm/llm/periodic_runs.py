"""Maximal periodic runs of words, by the Stoye-Gusfield traversal of a suffix tree.

A run is a stretch of consecutive words with smallest period q, at least `least` words and
`exponent` periods long, that neither neighbour extends with that period.

1. Every word of a run occurs in it `exponent` times or more, so words that occur less often cut
   a text into stretches that hold its runs whole. Words are counted again within the stretches,
   until nothing more is cut. What is left is little of ordinary text and most of a periodic one.
2. The suffix tree of the stretches is laid out over their suffix array: prefix doubling gives the
   order, the ranks of each doubling give the words that any two places have in common ahead or
   behind, and each gap between neighbours is a node as deep as their common prefix, whose two
   sides are stretches of the array (a node of several children is several such nodes).
3. For each node of depth p, the leaves i of the smaller side alone are listed: i and i + p, or
   i - p and i, on the two sides of it are a branching tandem repeat of period p. A leaf is listed
   again only in a side at least twice as large, so n words are listed n log n times at most.
4. A branching repeat ends where a run ends. It is rotated to the left as far as its period holds,
   which gives the run whole; repeats of multiples of a period give the same stretch, and these
   are merged under the smallest.

Texts are dealt with in batches of about BATCH_WORDS words; a text is never cut, so the memory of
a task is about twenty times its longest text.

Defined cases: null and empty texts have no words and no runs; ids are only carried along, so null
and repeated ones keep their rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 1 << 18
LISTED = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixTree:
    """Suffix trees of strings laid end to end: keys are equal only where symbols of one string
    are, and ends[i] is where the string of place i ends."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray):
        self.n = n = len(keys)
        self.ranks: list[np.ndarray] = []
        places = np.arange(n)
        rank = np.unique(keys, return_inverse=True)[1] + 1
        width = 1
        while True:
            # place n is beyond all strings and like no other
            self.ranks.append(np.append(rank, 0).astype(np.int32))
            if int(rank.max()) == n:
                break
            after = places + width
            rank = np.unique(rank * (n + 1) + np.where(after < ends, rank[np.minimum(after, n - 1)], 0), return_inverse=True)[1] + 1
            width *= 2
        self.place = rank - 1
        self.order = np.empty(n, np.int64)
        self.order[self.place] = places
        self.common = np.zeros(n, np.int64)
        self.common[1:] = self.ahead(self.order[:-1], self.order[1:])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on are alike (a != b)."""
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[level][a] == self.ranks[level][b]).astype(np.int64) << level
            a, b, got = a + step, b + step, got + step
        return got

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols just before places a < b are alike."""
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            there = a >= 1 << level
            step = np.where(there, 1 << level, 0)
            step[self.ranks[level][a - step] != self.ranks[level][b - step]] = 0
            a, b, got = a - step, b - step, got + step
        return got

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, cut, last) of each node: its leaves are order[first:last], on two sides of cut."""
        common = self.common.tolist()
        first, last = [0] * self.n, [self.n] * self.n
        open_: list[int] = []
        for k, depth in enumerate(common):
            while open_ and common[open_[-1]] > depth:
                last[open_.pop()] = k
            first[k] = open_[-1] if open_ else 0
            open_.append(k)
        cut = np.nonzero(self.common > 0)[0]
        return np.asarray(first)[cut], cut, np.asarray(last)[cut]

    def branching_repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, period) of the squares whose two halves go on differently."""
        first, cut, last = self.nodes()
        left = cut - first <= last - cut
        low, high = np.where(left, first, cut), np.where(left, cut, last)
        far_low, far_high = np.where(left, cut, first), np.where(left, last, cut)
        sizes = high - low
        batch = (np.cumsum(sizes) - sizes) // LISTED
        bounds = np.searchsorted(batch, np.unique(batch)).tolist() + [len(cut)]
        for x, y in zip(bounds, bounds[1:], strict=False):
            node = np.repeat(np.arange(x, y), sizes[x:y])
            within = np.arange(len(node)) - np.repeat(np.cumsum(sizes[x:y]) - sizes[x:y], sizes[x:y])
            leaf = self.order[low[node] + within]
            period = self.common[cut[node]]
            for other, start in ((leaf + period, leaf), (leaf - period, leaf - period)):
                there = np.nonzero((other >= 0) & (other < self.n))[0]
                at = self.place[other[there]]
                met = there[(at >= far_low[node[there]]) & (at < far_high[node[there]])]
                yield start[met], period[met]

    def runs(self, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all runs, by start and period."""
        found = []
        for start, period in self.branching_repeats():
            end = start + 2 * period
            start = start - self.behind(start, start + period)
            long = end - start >= np.maximum(least, exponent * period)
            found.append(np.stack([start[long], end[long] - start[long], period[long]]))
        start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        by = np.lexsort((period, length, start))
        start, length, period = start[by], length[by], period[by]
        new = np.ones(len(by), bool)
        new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = start[new], length[new], period[new]
        by = np.lexsort((period, start))
        return start[by], length[by], period[by]


def stretches(code: np.ndarray, owner: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, keys, ends) of the stretches that can hold runs: places within code, keys as
    SuffixTree asks for, and ends within places."""
    at = np.arange(len(code))
    keys = owner * (int(code.max(initial=0)) + 1) + code
    while len(at):
        inverse, often = np.unique(keys, return_inverse=True, return_counts=True)[1:]
        stay = often[inverse] >= exponent
        at = at[stay]
        if not len(at):
            break
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        part = np.cumsum(cut) - 1
        size = np.bincount(part)
        wide = size[part] >= least
        keys = part[wide] * (int(code.max()) + 1) + code[at[wide]]
        done = bool(stay.all() and wide.all())
        at, ends = at[wide], np.cumsum(size)[part[wide]]
        if done:
            return at, keys, ends
    none = np.zeros(0, np.int64)
    return none, none, none


def batch_runs(texts: list[list[bytes]], least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of all texts, by text, start and period."""
    codes, owners = [], []
    for i, words in enumerate(texts):
        if len(words) >= least:
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            if len(words) - len(number) + 1 >= exponent:  # else no word occurs so often
                codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                owners.append(np.full(len(words), i, np.int64))
    none = np.zeros(0, np.int64)
    if not codes:
        return none, none, none, none
    owner = np.concatenate(owners)
    at, keys, ends = stretches(np.concatenate(codes), owner, least, exponent)
    if not len(at):
        return none, none, none, none
    start, length, period = SuffixTree(keys, ends).runs(least, exponent)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    text = owner[at[start]]
    return text, at[start] - begin[np.searchsorted(begin, at[start], side="right") - 1], length, period


def _kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join([words[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0].tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: runs by start and period, and the text, its
    words joined by one space, with one period left of each run."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.col(text) if isinstance(text, str) else text).cast("string").cast("binary").alias("t"))
    of_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < len(batch):
                # bytes.split() parts at space, tab to carriage return, and nothing else
                texts: list[list[bytes]] = []
                size = 0
                while begin + len(texts) < len(batch) and size < BATCH_WORDS:
                    texts.append((batch.column(1)[begin + len(texts)].as_py() or b"").split())
                    size += len(texts[-1])
                owner, *run = batch_runs(texts, least, exponent)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                kept = [_kept(w, *[x[a:b] for x in run]) if b > a else b" ".join(w) for w, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in run], fields=list(of_run)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array([len(w) for w in texts], pa.int64()), lists, pa.array(kept, pa.binary())], ["id", "n_words", "runs", "collapsed"])
                begin += len(texts)

    found = rows.mapInArrow(work, f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a periodic tail in the texts whose id's crc32 ends in 0: from word g % n on, the
    words repeat with period 1 + (n - g % n) / (3 + g % 8), where g is that crc32 / 10. Texts of
    null ids stay as they are."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    text = F.col(f"`{text_col}`").cast("string")
    words = docs.withColumn("__w", F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    n = F.size("__w")
    a = (g % n).cast("int")
    tail = n - a
    p = (1 + F.floor(tail / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("__w", a + 1, p), F.ceil(tail / p).cast("int"))), F.lit(1), tail)
    made = F.array_join(F.concat(F.slice("__w", F.lit(1), a), again), " ")
    return words.withColumn(text_col, F.when(F.coalesce(n, F.lit(0)) > 0, made).otherwise(text)).drop("__w")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The run with the greatest exact length / period of each row (the first of several), and the
    SHA-256 of all its runs and of the collapsed text."""
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> CASE WHEN r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("__b", best).select(
        F.col(f"`{id_col}`"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"__b.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("__b.length") / F.col("__b.period")).cast("long").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
