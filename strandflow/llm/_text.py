"""Vectorised work on the bytes of whole Arrow text columns: words, hashes, sums by document.

A text column's value buffer is one long byte array with offsets.  Here it is
cut into chunks of bounded bytes (a longer text is a chunk of its own, never a
prefix), and words, rolling hashes and per-document sums are numpy passes over
a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(arr: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with at most `most` bytes, or one longer text."""
    data, off = buffers(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of maximal runs of word bytes within documents."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    m = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    gap = np.ones(n + 1, bool)
    gap[1:n] = ~m[:-1] | ~m[1:]
    gap |= edge
    starts = np.flatnonzero(m & gap[:-1])
    ends = np.flatnonzero(m & gap[1:]) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _ODD), ("down", U64(pow(int(_ODD), -1, 1 << 64)))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any byte ranges of a chunk, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


    def every(self, size: int) -> np.ndarray:
        """Unmixed hashes of all ranges of one size, by start."""
        n = len(self.sums) - 1
        return (self.sums[size:] - self.sums[: n - size + 1]) * self.down[: n - size + 1]


def hash_bytes(words: list[bytes]) -> np.ndarray:
    """The hashes that Rolling gives these byte strings."""
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) for w in words])
    return Rolling(np.frombuffer(b"".join(words), np.uint8)).of(np.concatenate([[0], ends[:-1]]), ends)


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers of k-word shingles; fewer words are one shingle, none give none."""
    n = len(words)
    coef = [mix(np.array([j + 1], np.uint64))[0] | U64(1) for j in range(k)]
    count = np.bincount(doc, minlength=n_docs) if n else np.zeros(n_docs, np.int64)
    first = np.cumsum(count) - count
    out_h, out_d = [], []
    if n >= k:
        h = words[: n - k + 1] * coef[0]
        for j in range(1, k):
            h = h + words[j : n - k + 1 + j] * coef[j]
        whole = doc[: n - k + 1] == doc[k - 1 :]
        out_h.append(mix(h[whole] + U64(k)))
        out_d.append(doc[: n - k + 1][whole])
    for m in range(1, k):
        d = np.flatnonzero(count == m)
        if len(d):
            h = np.zeros(len(d), np.uint64)
            for j in range(m):
                h = h + words[first[d] + j] * coef[j]
            out_h.append(mix(h + U64(m)))
            out_d.append(d)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)


def distinct(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted by document and then hash."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]
