"""Exact removal of repeated byte strings with a distributed, sparse suffix array.

Every byte covered by a string of `need` bytes that also starts anywhere else is found, and
removed. Comparing the suffixes at all places would ship each text hundreds of times, so only
suffixes at anchors are kept. An anchor is the place with the smallest hash of the 8 bytes that
start there (the leftmost, if several) among the first `need - LEAD + 1` places of some string
of `need` bytes; equal strings have equal anchors, so each string start belongs to one anchor,
at one distance before it, and equal starts meet at equal distances.

1. Anchors whose LEAD leading bytes occur once in the corpus are dropped: no repeated string can
   belong to them. Each task sends a leading hash once, whatever the number of its copies.
2. The anchors left over are given their context, the bytes that the strings of theirs cover.
   Copies within a task are settled there, and one of them is sent on.
3. Sampled splitters range-partition the suffixes by their leading bytes. Each bucket sorts its
   suffixes, and the reversed texts before the anchors, by multikey quicksort over words of 8
   bytes. Two starts at distance d are equal when the suffixes share need - d bytes and the
   reversed texts share d, that is, when they lie in one run of each order cut at these lengths.
   A splitter is a leading string of LEAD bytes and equal leads are not parted, so suffixes on
   two sides of a boundary differ within LEAD bytes and share no string: the comparison across
   boundaries is settled by the choice of splitters, for any number of buckets. Copies that meet
   in a bucket are adjacent; they are settled as they come, and one of them is kept.
4. A lead of more than HOT suffixes is split by deeper splitters. Its suffixes are range-partitioned
   by all their bytes, so that copies meet and are settled; those left over go out once for each
   band of BANDS[0] distances, keyed by the bytes that all strings of the band share, and once more
   in bands of BANDS[1] = 1 where even such a key is hot. The key of a band of 1 is the string
   itself, of which a bucket keeps one. So a bucket holds HOT + CHUNK suffixes at most.
5. The covered ranges of each document are united and cut out.

Rows are told apart by 128 bits of hash of id and text.

Defined cases: null texts are empty; texts shorter than `need` bytes lose nothing; rows that
repeat are copies of each other and so lose everything they could (if `need` bytes long); null
ids are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghelm.llm.bytehash import mix
from loghelm.llm.common import Scratch, text_or_empty

LEAD = 64
BATCH_BYTES = 2_000_000
CHUNK = 40_000
HOT = 50_000
BANDS = (16, 1)
ROW = ["doc", "doc2"]
RANGE = "doc long, doc2 long, lo int, hi int"
FOUND = "doc long, doc2 long, at int, near int, far int, lo int, hi int, context binary"


def words_at(raw: bytes, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places, as one number."""
    return np.ndarray((n,), "<u8", raw, 0, (1,))


def anchors(texts: list[bytes], need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, nearest, farthest, lead hash) of all anchors of the texts.

    The strings of an anchor start `nearest` to `farthest` bytes before it.
    """
    none = np.zeros(0, np.int64)
    raw = b"".join(texts)
    sizes = np.asarray([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    if len(raw) < need:
        return none, none, none, none, none.view(np.uint64)
    span = need - LEAD + 1
    n = len(raw) - 7
    grams = mix(words_at(raw, n).astype(np.uint64))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    ok = np.maximum(sizes - need + 1, 0)
    text = np.repeat(np.arange(len(texts)), ok)
    start = np.repeat(begins - (np.cumsum(ok) - ok), ok) + np.arange(int(ok.sum()))
    if not len(start):
        return none, none, none, none, none.view(np.uint64)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))[0]
    last = np.append(cut[1:], len(at)) - 1
    at, text, farthest, nearest = at[cut], text[cut], at[cut] - start[cut], at[last] - start[last]
    words = words_at(raw, n)
    lead = np.zeros(len(at), np.uint64)
    for i in range(0, LEAD, 8):
        lead = mix(lead * np.uint64(0x9FB21C651E98DF25) + words[at + i])
    return text, at - begins[text], nearest, farthest, lead


def _batches(texts: list, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Multikey quicksort: the order of rows of 8-byte words.

    A segment is a run of rows known to share its first `depth` words. Each round parts all open
    segments at once into the rows below, at and above a pivot (the median of three) in the next
    word; the rows at the pivot go on to the word after it.
    """
    m, width = words.shape
    words = words.astype(np.uint64)
    order, depth = np.arange(m), np.zeros(m, np.int64)
    segment = np.zeros(m, np.int64)  # place where the segment of each place begins
    open_ = np.arange(m) if m > 1 else np.zeros(0, np.int64)
    while len(open_):
        rows, at = order[open_], depth[open_]
        value = words[rows, at]
        first = np.flatnonzero(np.diff(segment[open_], prepend=-1))
        size = np.diff(np.append(first, len(open_)))
        trio = np.sort(np.stack([value[first], value[first + size // 2], value[first + size - 1]]), axis=0)
        pivot = np.repeat(trio[1], size)
        part = np.repeat(np.arange(len(first)), size) * 3 + (value >= pivot) + (value > pivot)
        inner = np.argsort(part, kind="stable")
        order[open_], part = rows[inner], part[inner]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        size = np.diff(np.append(first, len(open_)))
        segment[open_] = np.repeat(open_[first], size)
        depth[open_] = at + (part % 3 == 1)  # `at` is one value in each old segment
        open_ = open_[(np.repeat(size, size) > 1) & (depth[open_] < width)]
    return order


def _shared(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in the order shares with the one before (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = rows[order[1:]], rows[order[:-1]]
        same = a == b
        n = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
        out[1:] = np.minimum(n, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return out


def repeated_starts(contexts: list[bytes], nearest: np.ndarray, farthest: np.ndarray, need: int) -> np.ndarray:
    """flags[i, d]: the string d bytes before anchor i also starts at another anchor."""
    m = len(contexts)
    most = need - LEAD
    right = np.zeros((m, -(-need // 8) * 8), np.uint8)
    left = np.zeros((m, -(-max(most, 1) // 8) * 8), np.uint8)
    sizes = need - nearest
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    at = ends - np.asarray([len(c) for c in contexts]) + farthest
    col = np.arange(right.shape[1])
    inside = col[None, :] < sizes[:, None]
    right[inside] = flat[(at[:, None] + col[None, :])[inside]]
    col = np.arange(left.shape[1])
    inside = col[None, :] < farthest[:, None]
    left[inside] = flat[(at[:, None] - 1 - col[None, :])[inside]]
    r_order, l_order = multikey_order(right.view(">u8")), multikey_order(left.view(">u8"))
    r_shared, l_shared = _shared(right, sizes, r_order), _shared(left, farthest, l_order)
    flags = np.zeros((m, most + 1), bool)
    r_run, l_run = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(nearest.min()), int(farthest.max()) + 1):
        own = np.nonzero((nearest <= d) & (d <= farthest))[0]
        if len(own) < 2:
            continue
        r_run[r_order] = np.cumsum(r_shared < need - d)
        l_run[l_order] = np.cumsum(l_shared < d)
        both = r_run[own] * (m + 1) + l_run[own]
        order = np.argsort(both, kind="stable")
        same = np.zeros(len(own), bool)
        same[1:] = both[order[1:]] == both[order[:-1]]
        same[:-1] |= same[1:]
        flags[own[order[same]], d] = True
    return flags


def _ranges(f: pd.DataFrame, flags: np.ndarray, need: int) -> pd.DataFrame:
    """The byte ranges covered by the flagged starts, one for each run of distances."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, d_lo = np.nonzero(edge == 1)
    _, d_hi = np.nonzero(edge == -1)
    at = f["at"].to_numpy(np.int64)[row]
    return f[ROW].iloc[row].assign(lo=(at - (d_hi - 1)).astype(np.int32), hi=(at - d_lo + need).astype(np.int32))


def _merged(f: pd.DataFrame, need: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(ranges, rest): of suffixes in order, adjacent copies (equal context at equal distances)
    are covered whole, and the first of them is kept with lo = -1, as settled."""
    far, context = f["far"].to_numpy(), f["context"].tolist()
    same = np.zeros(len(f), bool)
    same[1:] = [i == j and a == b for i, j, a, b in zip(far[1:], far, context[1:], context)]
    copy = same.copy()
    copy[:-1] |= same[1:]
    lo = f["lo"].to_numpy()
    # a kept first stands for copies wherever one of its run was settled before
    run = np.cumsum(~same) - 1
    settled = copy | (np.bincount(run, weights=lo < 0, minlength=1)[run] > 0 if len(f) else copy)
    done = f[settled & (lo >= 0)]
    ranges = done[ROW].assign(lo=done["at"] - done["far"], hi=done["at"] - done["near"] + need)
    rest = f.assign(lo=np.where(settled, -1, lo).astype(np.int32))[~same].reset_index(drop=True)
    return ranges, rest


def _banded(rows: DataFrame, need: int, width: int) -> DataFrame:
    """Each suffix once for each band of `width` distances that its strings fall in, cut to the
    bytes of these, with `lead`: the bytes that any string of the band has."""
    out = rows.withColumn("from", F.explode(F.sequence(F.col("near") - F.col("near") % width, F.col("far"), F.lit(width))))
    out = out.withColumns({"near_": F.greatest("near", "from").cast("int"), "far_": F.least("far", F.col("from") + width - 1).cast("int")})
    out = out.withColumn("context", F.substring("context", F.col("far") - F.col("far_") + 1, F.col("far_") + need - F.col("near_")))
    lead = F.substring("context", (F.col("far_") - F.col("from") + 1).cast("int"), F.lit(need - width + 1))
    return out.select(*ROW, "at", F.col("near_").alias("near"), F.col("far_").alias("far"), "lo", "hi", "context", lead.alias("lead"))


def suffix_dedup(docs: DataFrame, need: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and spans (array of
    struct<lo, hi>: the removed byte ranges). `hot` suffixes of one lead at most meet in a task."""
    if not LEAD < need <= LEAD + 250:
        raise ValueError(f"need must be above {LEAD} and at most {LEAD + 250} bytes")
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = texts.withColumns({"doc": F.xxhash64("doc_id", "text"), "doc2": F.xxhash64(F.lit(1), "text", "doc_id")})

    def leads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, docs_, docs2, places = [], [], [], []
        for f in frames:
            ids, ids2 = f["doc"].to_numpy(), f["doc2"].to_numpy()
            for first, raws in _batches(f["text"].tolist()):
                text, at, near, far, lead = anchors(raws, need)
                hashes.append(lead)
                docs_.append(ids[first + text])
                docs2.append(ids2[first + text])
                places.append((at << 16) | (near << 8) | far)
        if not hashes:
            return
        h, doc, doc2, place = (np.concatenate(x) for x in (hashes, docs_, docs2, places))
        order = np.argsort(h, kind="stable")
        h, doc, doc2, place = h[order], doc[order], doc2[order], place[order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        more = same.copy()
        more[:-1] |= same[1:]
        kind = more.astype(np.int32)  # 1: known to repeat
        out = pd.DataFrame({"h": h.view(np.int64), "doc": doc, "doc2": doc2, "place": place, "kind": kind})
        yield out
        yield out[more & ~same].assign(kind=2)  # stands for the copies of this task

    seen = scratch.keep(texts.select(*ROW, "text").mapInPandas(leads, "h long, doc long, doc2 long, place long, kind int"))
    w = Window.partitionBy("h")
    sent = seen.where("kind <> 1").withColumn("n", F.count(F.lit(1)).over(w))
    known = seen.where("kind = 1").select(*ROW, "place").unionByName(sent.where("n > 1 and kind = 0").select(*ROW, "place"))
    by_doc = scratch.keep(known.groupBy(*ROW).agg(F.collect_set("place").alias("places")))
    scratch.drop(seen)

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: dict[tuple[bytes, int], tuple] = {}
        for f in frames:
            out = []
            for doc, doc2, text, places in zip(f["doc"], f["doc2"], f["text"], f["places"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for place in places.tolist():
                    at, near, far = place >> 16, place >> 8 & 255, place & 255
                    key = (raw[at - far : at + need - near], far)
                    first = sent.get(key)
                    if first is None:
                        sent[key] = (doc, doc2, at, near, 0)
                        continue
                    if first[4] == 0:  # the first of these copies is settled with them
                        out.append((first[0], first[1], first[2] - far, first[2] - first[3] + need))
                        sent[key] = (doc, doc2, at, near, -1)
                    out.append((doc, doc2, at - far, at - near + need))
            if out:
                d, d2, lo, hi = zip(*out, strict=True)
                yield pd.DataFrame({"doc": np.asarray(d, np.int64), "doc2": np.asarray(d2, np.int64), "at": 0, "near": 0, "far": 0, "lo": np.asarray(lo, np.int32), "hi": np.asarray(hi, np.int32), "context": None})
        rows = [(doc, doc2, at, near, far, lo, context) for (context, far), (doc, doc2, at, near, lo) in sent.items()]
        for i in range(0, len(rows), 20_000):
            doc, doc2, at, near, far, lo, context = zip(*rows[i : i + 20_000], strict=True)
            yield pd.DataFrame({"doc": np.asarray(doc, np.int64), "doc2": np.asarray(doc2, np.int64), "at": at, "near": near, "far": far, "lo": lo, "hi": 0, "context": context})

    met = texts.select(*ROW, "text").join(by_doc, ROW).select(*ROW, "text", "places")
    found = scratch.keep(met.mapInPandas(contexts, FOUND))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def settle(f: pd.DataFrame) -> pd.DataFrame:
            near, far = f["near"].to_numpy(np.int64), f["far"].to_numpy(np.int64)
            flags = repeated_starts(f["context"].tolist(), near, far, need)
            flags[f["lo"].to_numpy() < 0] = False  # stands for copies that are settled
            return _ranges(f, flags, need)

        for f in frames:
            ranges, rest = _merged(f if rest is None else pd.concat([rest, f], ignore_index=True), need)
            yield ranges
            if len(rest) < CHUNK:
                continue
            last = rest["lead"].iloc[-1]
            same = np.asarray([x == last for x in rest["lead"]])
            if not same.all():
                yield settle(rest[~same].reset_index(drop=True))
                rest = rest[same].reset_index(drop=True)
        if rest is not None and len(rest):
            yield settle(rest)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for f in frames:
            f = f.drop(columns="lead")
            ranges, f = _merged(f if rest is None else pd.concat([rest, f], ignore_index=True), need)
            yield ranges.assign(at=0, near=0, far=0, context=None)
            yield f.iloc[:-1]
            rest = f.iloc[-1:]  # the next batch may go on with copies of it
        if rest is not None:
            yield rest

    tables, parts = [found], []
    todo = found.where("context is not null").withColumn("lead", F.substring("context", F.col("far") + 1, F.lit(LEAD)))
    for width in (*BANDS, None):
        crowded = None
        if width is not None:
            crowded = scratch.keep(todo.groupBy("lead").count().where(F.col("count") > hot).select("lead"))
            tables.append(crowded)
            if crowded.isEmpty():
                crowded = None
        rest = todo if crowded is None else todo.join(crowded, "lead", "left_anti")
        order = ("lead", "far", "context")
        parts.append(rest.repartitionByRange("lead").sortWithinPartitions(*order).mapInPandas(compare, RANGE))
        if crowded is None:
            break
        # the join's strategy goes by the written size of `crowded`, and AQE splits the hot keys
        apart = todo.join(crowded, "lead", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
        thin = scratch.keep(apart.mapInPandas(merge, FOUND))
        tables.append(thin)
        todo = _banded(thin.where("context is not null"), need, width)
    ranges = [t.where("context is null").select(*ROW, "lo", "hi") for t in tables if "context" in t.columns] + parts
    covered = reduce(DataFrame.unionByName, ranges).groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    covered = scratch.keep(covered)
    scratch.drop(*tables, by_doc)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for text, ranges_ in zip(f["text"], f["ranges"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges_) if ranges_ is not None else ():
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], hi)
                    else:
                        own.append([lo, hi])
                left, at = hashlib.sha256(), 0
                for lo, hi in own:
                    left.update(raw[at:lo])
                    at = hi
                left.update(raw[at:])
                n_bytes.append(len(raw))
                n_removed.append(sum(hi - lo for lo, hi in own))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in own])
                kept.append(left.hexdigest())
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": [len(s) for s in spans], "kept_sha256": kept, "spans": spans})

    kind = texts.schema["doc_id"].dataType.simpleString()
    whole = texts.join(covered, ROW, "left").select("doc_id", "text", "ranges")
    if kind == "bigint":  # a null id must not turn the column into floats
        whole = whole.withColumn("doc_id", F.col("doc_id").cast("string"))
        out = whole.mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>")
        return out.withColumn("doc_id", F.col("doc_id").cast("long"))
    return whole.mapInPandas(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>")
