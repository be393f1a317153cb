"""64-bit hashes of many words at once, and the exact comparison of words with those held.

A word is read 8 bytes at a time, and every step passes through a bijection that spreads all
bits, so no regular structure of a word makes two of one length meet more often than chance.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: longer words are hashed one by one
LONG = 256
_STEP = np.uint64(0x9FB21C651E98DF25)
_MASK = np.asarray([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[begin:stop] (uint8) for each pair."""
    size = stop - begin
    out = mix(size.astype(np.uint64) + _STEP)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    short = np.nonzero(size <= LONG)[0]
    at, left, h = begin[short], size[short], out[short]
    while len(short):
        h = mix((h ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _STEP)
        more = left > 8
        out[short[~more]] = h[~more]
        short, at, left, h = short[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.nonzero(size > LONG)[0].tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[begin[i] : stop[i]].tobytes()))
    return out


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_at : a_at + size] equals b[b_at : b_at + size], for each triple."""
    ends = np.cumsum(size)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    differs = a[np.repeat(a_at, size) + within] != b[np.repeat(b_at, size) + within]
    return np.bincount(np.repeat(np.arange(len(size)), size)[differs], minlength=len(size)) == 0
