"""Slices of a byte array, grouped exactly: XXH64 of all slices at once, then a comparison byte by byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of slices of a byte array; all slices advance together."""
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at64 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at32 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    pos, acc = starts.astype(np.int64).copy(), np.full(len(size), _P5, np.uint64)
    step = lambda a, lane: _rotl(a + lane * _P2, 31) * _P1
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), x, np.uint64) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            left = long
            on = np.arange(len(long))
            while len(left):
                for k in range(4):
                    lanes[k][on] = step(lanes[k][on], at64[pos[left] + 8 * k])
                pos[left] += 32
                more = ends[left] - pos[left] >= 32
                left, on = left[more], on[more]
            a = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for k in range(4):
                a = (a ^ step(np.zeros(len(long), np.uint64), lanes[k])) * _P1 + _P4
            acc[long] = a
        acc += size.astype(np.uint64)
        todo = np.flatnonzero(ends - pos >= 8)
        while len(todo):
            acc[todo] = _rotl(acc[todo] ^ step(np.zeros(len(todo), np.uint64), at64[pos[todo]]), 27) * _P1 + _P4
            pos[todo] += 8
            todo = todo[ends[todo] - pos[todo] >= 8]
        todo = np.flatnonzero(ends - pos >= 4)
        acc[todo] = _rotl(acc[todo] ^ (at32[pos[todo]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[todo] += 4
        todo = np.flatnonzero(ends > pos)
        while len(todo):
            acc[todo] = _rotl(acc[todo] ^ (data[pos[todo]].astype(np.uint64) * _P5), 11) * _P1
            pos[todo] += 1
            todo = todo[ends[todo] > pos[todo]]
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
    return acc ^ (acc >> np.uint64(32))


def _unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which slices differ in a byte from the slice `first` names, compared in pieces of bounded size."""
    size = ends - starts
    bad = size != size[first]
    rows = np.flatnonzero((first != np.arange(len(first))) & ~bad)
    total = np.cumsum(size[rows])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), "right")))
        r = rows[lo:hi]
        n = size[r]
        for cut in range(0, int(n.max()), 1 << 20):  # a slice longer than the bound is compared piece by piece
            m = np.clip(n - cut, 0, 1 << 20)
            off = np.cumsum(m) - m
            step = np.arange(int(m.sum())) - np.repeat(off, m) + cut
            differs = data[np.repeat(starts[r], m) + step] != data[np.repeat(starts[first[r]], m) + step]
            if differs.any():
                bad[np.repeat(r, m)[differs]] = True
        lo = hi
    return bad


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=xxh64) -> tuple[np.ndarray, np.ndarray]:
    """(number of its distinct bytes for each slice, a slice that stands for each number): by hash, then verified by bytes."""
    _, first, of = np.unique(hashed(data, starts, ends), return_index=True, return_inverse=True)
    bad = _unlike(data, starts, ends, first[of]) if len(starts) else np.zeros(0, bool)
    if bad.any():  # unequal bytes under one hash: such slices are numbered by their bytes
        found: dict[bytes, int] = {}
        for i in np.flatnonzero(bad):
            word = data[starts[i] : ends[i]].tobytes()
            if word not in found:
                found[word] = len(first)
                first = np.append(first, i)
            of[i] = found[word]
    return of, first


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as strings."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - off[:-1], size) + np.arange(int(off[-1]))
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())
