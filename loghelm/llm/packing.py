"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Texts are tokenized and cut where longer than a sequence. Each task packs its own pieces: a bin
is filled greedily with the longest piece that still fits; then its smallest piece is replaced
by two unpacked pieces where these fill the widened gap more tightly. Bins left with a gap of
`loose` tokens or more are opened again and packed together, across tasks, in a second round
over groups of at most about `group` pieces. Only lengths are shuffled, never tokens.

Where an order is given (`order_col`), texts are dealt in that order: a task packs consecutive
ranges of `range_docs` documents. Loose bins of a range are opened again with the next range of
the task, once, in place of the second round, so a sequence holds pieces of two neighbouring
ranges at most. Sequences are numbered range by range, in each by their first document.

Defined cases: null texts are empty; an empty text is the end token alone; null ids and repeated
rows are packed like any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghelm.llm import bytehash
from loghelm.llm.common import Scratch, text_or_empty

RANGE_DOCS = 2048
TASK_DOCS = 4 * RANGE_DOCS
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of a word-wise BPE tokenizer file, with the ids of words seen before kept.

    The file's rules (NFC, lower case, split into words by its pattern) are applied here, and
    only words not seen before are given to the library. Texts of ASCII and Latin-1 letters are
    split and looked up as arrays; other texts word by word; texts with characters on which the
    rules could differ between libraries are given to the library whole. Words are looked up by
    hash, then compared byte by byte; texts with two words of one hash go to the library whole.
    """

    KEPT_WORDS = 800_000
    ARRAY_CHARS = 2_000_000
    #: the tokenizer file's own pattern
    WHOLE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    LATIN_ONLY = frozenset(map(chr, [*range(0x1C), *range(0x20, 0x80), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    UNSURE = frozenset("\x1c\x1d\x1e\x1f\x85\u03a3\u0130\u1e9e\u2126\u212a\u212b")
    SHORTENED = re.compile(r"'[stmdrvl]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        codes = np.arange(256)
        letters = [c for c in range(256) if chr(c).isalpha() and chr(c) in self.LATIN_ONLY]
        self.lower = bytes(ord(chr(c).lower()) if c in letters else c for c in codes.tolist())
        self.allowed = bytes(c for c in range(256) if chr(c) in self.LATIN_ONLY)
        self.kind = np.zeros(256, np.uint8)
        self.kind[letters] = 1
        self.kind[[c for c in range(256) if chr(c).isdigit()]] = 2
        self.kind[[c for c in range(256) if chr(c).isspace()]] = 3
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.held = np.zeros(0, np.uint8)  # the words' bytes
        self.held_at = np.zeros(0, np.int64)
        self.held_size = np.zeros(0, np.int64)
        self.order = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _bpe(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after the other, and how many each has."""
        ids, sizes = [], []
        for i in range(0, len(words), 4000):
            some = words[i : i + 4000]
            got = np.asarray(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.nonzero(self.ends[got])[0] + 1
            if len(stops) == len(some):
                n = np.diff(stops, prepend=0)
            else:  # not word by word, so one call for each
                each = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                got = np.asarray([x for e in each for x in e], np.uint32)
                n = np.asarray([len(e) for e in each], np.int64)
            ids.append(got)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self._bpe([w.decode("latin-1") for w in words])
        n_bytes = np.asarray([len(w) for w in words], np.int64)
        self.held_at = np.concatenate([self.held_at, len(self.held) + np.cumsum(n_bytes) - n_bytes])
        self.held_size = np.concatenate([self.held_size, n_bytes])
        self.held = np.concatenate([self.held, np.frombuffer(b"".join(words), np.uint8)])
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        order = np.arange(len(self.starts), len(self.starts) + len(words))
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, sizes])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.order = np.insert(self.order, at, order)

    def _arrays(self, texts: list[str]) -> list[np.ndarray]:
        raw = "\n".join(texts).encode("latin-1").translate(self.lower)
        if not raw:
            return [np.zeros(0, np.uint32) for _ in texts]
        data = np.frombuffer(raw, np.uint8)
        kind = self.kind[data]
        turns = np.ones(len(data) + 1, bool)
        turns[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        turns = np.nonzero(turns)[0]
        word = kind[turns[:-1]] != 3
        begin, stop = turns[:-1][word], turns[1:][word]
        hashes = bytehash.word_hashes(data, begin, stop)
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(own) + len(self.hashes) > self.KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, own)
        new = np.ones(len(own), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != own[inside]
        size, same = stop - begin, first[inverse]
        old, known = first[~new], self.order[at[~new]]
        if not (
            (size == size[same]).all()
            and (size[old] == self.held_size[known]).all()
            and bytehash.same_bytes(data, begin, data, begin[same], size).all()
            and bytehash.same_bytes(data, begin[old], self.held, self.held_at[known], size[old]).all()
        ):
            return [np.asarray(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        if new.any():
            f = first[new]
            self._learn(own[new], [raw[a:b] for a, b in zip(begin[f].tolist(), stop[f].tolist(), strict=True)])
        where = self.order[np.searchsorted(self.hashes, own)][inverse]
        n = self.lengths[where]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[where] - (ends - n), n) + np.arange(total)]
        text_stops = np.cumsum([len(t) + 1 for t in texts])
        words_upto = np.searchsorted(begin, text_stops)
        cuts = np.concatenate([[0], ends])[words_upto]
        return np.split(ids, cuts[:-1])

    def _plain(self, text: str) -> bool:
        try:
            if text.encode("latin-1").translate(None, self.allowed):
                return False
        except UnicodeEncodeError:
            return False
        return "<|" not in text and not ("'" in text and self.SHORTENED.search(text.lower()))

    def _one(self, text: str) -> np.ndarray:
        if not self.UNSURE.isdisjoint(text) or "<|" in text or len(text) < 200:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        low = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        words = self.WHOLE.findall(low)
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if not known:
            return np.zeros(0, np.uint32)
        ids, n = self._bpe(list(known))
        parts = np.split(ids, np.cumsum(n)[:-1])
        return np.concatenate([parts[known[w]] for w in words])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        chars = 0

        def flush() -> None:
            for i, ids in zip(plain, self._arrays([texts[i] for i in plain]), strict=True):
                out[i] = ids

        for i, t in enumerate(texts):
            if len(t) > self.ARRAY_CHARS or not self._plain(t):
                out[i] = self._one(t)
                continue
            if chars + len(t) > self.ARRAY_CHARS and plain:
                flush()
                plain, chars = [], 0
            plain.append(i)
            chars += len(t) + 1
        if plain:
            flush()
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, all between 1 and capacity."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    upto = np.cumsum(count)  # pieces of length n: order[upto[n] - count[n] : upto[n]] before any is taken
    first = upto - count
    left = count.copy()
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # fits[n]: a length of at most n that has pieces left, or 0; found with path halving
    fits = list(range(capacity + 1))
    for n in range(1, capacity + 1):
        if not left[n]:
            fits[n] = n - 1

    def longest(n: int) -> int:
        while fits[n] != n:
            fits[n] = fits[fits[n]]
            n = fits[n]
        return n

    left_of = left.tolist()

    def take(n: int) -> None:
        left_of[n] -= 1
        if not left_of[n]:
            fits[n] = n - 1

    def give_back(n: int) -> None:
        nonlocal fits
        left_of[n] += 1
        if left_of[n] == 1:  # paths may have skipped it
            top = 0
            fits = [0] * (capacity + 1)
            for m in range(1, capacity + 1):
                if left_of[m]:
                    top = m
                fits[m] = top

    at = 0
    todo = len(lengths)
    while todo:
        held: list[int] = []
        gap = capacity
        while gap and (n := longest(gap)):
            take(n)
            held.append(n)
            gap -= n
        if gap and len(held) > 1:
            small = held[-1]
            wide = gap + small
            best, pair = small, None
            a = longest(wide - 1)
            while a and 2 * a > best:
                b = longest(min(a, wide - a))
                if a == b and left_of[a] < 2:
                    b = longest(min(a - 1, wide - a))
                if b and best < a + b <= wide:
                    best, pair = a + b, (a, b)
                    if best == wide:
                        break
                a = longest(a - 1)
            if pair:
                held[-1:] = pair
                take(pair[0])
                take(pair[1])
                give_back(small)
        offset = 0
        for n in held:
            # pieces of one length are handed out from the first on
            i = order[first[n]]
            first[n] += 1
            bins[i], offsets[i] = at, offset
            offset += n
        todo -= len(held)
        at += 1
    return bins, offsets


def _place(frame: pd.DataFrame, capacity: int, round_: int) -> pd.DataFrame:
    bins, offsets = best_two_fit(frame["length"].to_numpy(), capacity)
    part = TaskContext.get().partitionId()
    return frame.assign(sequence_id=(np.int64(round_) << 60) + (np.int64(part) << 36) + bins, offset=offsets)


def _place_in_order(frame: pd.DataFrame, capacity: int, loose: int, range_docs: int) -> pd.DataFrame:
    """frame, with the column nth (place of the document in the task), packed range by range."""
    done: list[pd.DataFrame] = []
    base = 0
    held = frame.iloc[:0].assign(again=False)
    cuts = np.searchsorted(frame["nth"].to_numpy(), np.arange(0, frame["nth"].iloc[-1] + range_docs + 1, range_docs))
    last = len(cuts) - 2
    for r in range(last + 1):
        own = pd.concat([held, frame.iloc[cuts[r] : cuts[r + 1]].assign(again=False)], ignore_index=True)
        bins, offsets = best_two_fit(own["length"].to_numpy(), capacity)
        n = int(bins.max()) + 1 if len(bins) else 0
        fill = np.bincount(bins, weights=own["length"].to_numpy(), minlength=n)
        # a piece opened once already stays where it is now
        fixed = np.bincount(bins, weights=own["again"].to_numpy(bool), minlength=n) > 0
        out = np.full(n, r == last) | fixed | (fill > capacity - loose)
        begin = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(begin, bins, own["nth"].to_numpy())
        number = np.empty(n, np.int64)
        order = np.argsort(np.where(out, begin, np.iinfo(np.int64).max), kind="stable")
        number[order] = np.arange(n)
        stays = out[bins]
        done.append(own.assign(sequence_id=base + number[bins], offset=offsets)[stays])
        base += int(out.sum())
        held = own[~stays].assign(again=True)
    part = TaskContext.get().partitionId()
    whole = pd.concat(done, ignore_index=True)
    return whole.assign(sequence_id=(np.int64(part) << 36) + whole["sequence_id"]).drop(columns=["nth", "again"])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, loose: int = 24, group: int = 200_000, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, range_docs: int = RANGE_DOCS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokenizer_path)
        cols: list[list] = [[], [], [], [], [], []]
        nth = 0
        for f in frames:
            for i in range(0, len(f), 512):
                texts = f["text"].iloc[i : i + 512].tolist()
                for doc_id, ids in zip(f["doc_id"].iloc[i : i + 512], tok.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for c, x in zip(cols, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), nth), strict=True):
                            c.append(x)
                    nth += 1
        out = pd.DataFrame(dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "nth"), cols, strict=True)))
        if len(out):
            yield _place(out.drop(columns="nth"), capacity, 0) if order_col is None else _place_in_order(out, capacity, loose, range_docs)

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = list(frames)
        if all_:
            whole = pd.concat(all_, ignore_index=True)
            if len(whole):
                yield _place(whole, capacity, 1)

    # ids pass through pandas as text: as floats, a null beside them would cost digits
    scratch, number = Scratch(docs.sparkSession), F.col("doc_id").cast("long")
    if order_col is not None:
        rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(order_col).alias("at"))
        # kept before it is dealt: finding the bounds of ranges would work the order out once more
        rows = scratch.keep(rows)
        n = max(1, math.ceil(rows.count() / TASK_DOCS))
        return rows.repartitionByRange(n, "at").sortWithinPartitions("at").select("doc_id", "text").mapInPandas(first, PIECES).withColumn("doc_id", number)
    read = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    placed = scratch.keep(read.mapInPandas(first, PIECES))
    fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    loose_bins = scratch.keep(fill.where(F.col("fill") <= capacity - loose).select("sequence_id"))
    tight = placed.join(loose_bins, "sequence_id", "left_anti").select(*placed.columns)
    opened = placed.join(loose_bins, "sequence_id", "left_semi").select(*placed.columns)
    n = max(1, math.ceil(opened.count() / group))
    packed = opened.repartition(n).mapInPandas(again, PIECES)
    return tight.unionByName(packed).withColumn("doc_id", number)
