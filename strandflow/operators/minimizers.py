"""(w, k) minimizers of sequences, in Arrow batches, and the anchors that two tables share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest period whose repetition is left out; see `minimizer_places`.
MAX_PERIOD = 6
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE, _ONE = np.uint64(0x9E3779B97F4A7C15), np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def hashed(codes: np.ndarray, k: int) -> np.ndarray:
    """A mixed 63-bit hash of each k-mer of an array of letters: a polynomial of them, from sums of all letters before, so that k costs nothing."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate([_ONE, np.full(len(codes), x)])) for x in (_BASE, _INVERSE))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:-1], dtype=np.uint64)])
        h = (sums[k:] - sums[:-k]) * up[k - 1 : n + k - 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h >> np.uint64(1)


def minimizer_places(codes: np.ndarray, k: int, w: int, wild: int | None = ord("N"), max_period: int = MAX_PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-mers that have the least hash of some w neighbouring ones, the first of equals.

    Left out are k-mers with the letter `wild`, and those that stand a period of
    up to `max_period` letters before too: of a run such as AAAA or CACACA its
    first period is left, so that two runs share a few anchors and not the
    product of their lengths.
    """
    h = hashed(codes, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    out = np.zeros(len(h), bool)
    for p in range(1, min(max_period, len(h) - 1) + 1):
        out[p:] |= h[p:] == h[:-p]
    if wild is not None:
        bad = np.concatenate([[0], np.cumsum(codes == wild)])
        out |= bad[k:] > bad[:-k]
    h = np.where(out, _NONE, h)
    span = min(w, len(h))
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1) + np.arange(len(h) - span + 1))
    at = at[h[at] != _NONE]
    return at, h[at]


def all_places(texts: list[str], k: int, w: int, wild: int | None = ord("N"), max_period: int = MAX_PERIOD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts' numbers, places, hashes) of the minimizers of many texts that stand at one place of their text only, in few calls for all."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    h = hashed(codes, k)
    of = np.repeat(np.arange(len(texts)), size)[: len(h)]
    place = np.arange(len(h)) - start[of]
    inside = place <= size[of] - k
    out = ~inside
    for p in range(1, min(max_period, len(h) - 1) + 1):
        out[p:] |= (h[p:] == h[:-p]) & (place[p:] >= p)
    if wild is not None:
        bad = np.concatenate([[0], np.cumsum(codes == wild)])
        out |= bad[k:] > bad[:-k]
    h = np.where(out, _NONE, h)
    # a window of w k-mers, or of all of a text that has fewer
    at = [np.zeros(0, np.int64)]
    if len(h) >= w:
        first = np.flatnonzero(place[: len(h) - w + 1] <= size[of[: len(h) - w + 1]] - k - w + 1)
        best = first.copy()
        least = h[first]
        for i in range(1, w):
            less = h[first + i] < least
            best[less] = first[less] + i
            least = np.minimum(least, h[first + i])
        at.append(best)
    at += [np.array([s + h[s : s + n - k + 1].argmin()]) for s, n in zip(start.tolist(), size.tolist(), strict=True) if k <= n < k + w - 1]
    at = np.unique(np.concatenate(at))
    at = at[h[at] != _NONE]
    order = np.lexsort((h[at], of[at]))
    new = (np.diff(h[at][order], prepend=_NONE) != 0) | (np.diff(of[at][order], prepend=-1) != 0)
    at = at[np.sort(order[new & np.append(new[1:], True)])]
    return of[at], place[at], h[at]


#: Minimizers of an Arrow batch, about; those of a longer sequence are a batch of their own.
BATCH = 200_000


def minimizer_rows(df: DataFrame, seq: str, keep: list[str], k: int = 15, w: int = 5, once: bool = False) -> DataFrame:
    """keep, size (letters of the sequence), pos, hash: a row for each minimizer; with `once`, of hashes that stand at one place of the sequence only.

    Null and short sequences have none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, size, place, value, total = [], [], [], [], 0

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = pa.array(np.repeat(of, [len(x) for x in place]))
                cols = [pa.array(np.repeat(size, [len(x) for x in place]).astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(value).astype(np.int64))]
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keep))), *cols], [*keep, "size", "pos", "hash"])

            for row, t in enumerate(batch.column(len(keep)).to_pylist()):
                at, h = minimizer_places(np.frombuffer((t or "").encode("utf-32-le"), np.uint32), k, w)
                if once and len(h):
                    _, first, n = np.unique(h, return_index=True, return_counts=True)
                    only = np.sort(first[n == 1])
                    at, h = at[only], h[only]
                if not len(at):
                    continue
                of.append(row)
                size.append(len(t))
                place.append(at)
                value.append(h)
                total += len(at)
                if total > BATCH:
                    yield made()
                    of, size, place, value, total = [], [], [], [], 0
            if total:
                yield made()

    head = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return df.select(*keep, seq).mapInArrow(run, f"{head}, size int, pos int, hash long")


def has_repeat(seq: str, k: int) -> Column:
    """Whether some k letters stand at two places of a sequence; null for a null."""

    @F.pandas_udf("boolean")
    def repeats(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = hashed(np.frombuffer((t or "").encode("utf-32-le"), np.uint32), k)
            out.append(None if t is None else len(np.unique(h)) < len(h))
        return pd.Series(out, dtype="boolean")

    return repeats(F.col(seq))


def reverse_complement(seq):
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def anchors(queries: DataFrame, targets: DataFrame, k: int = 11, w: int = 5, both_strands: bool = True) -> DataFrame:
    """q_id, t_id, strand, q_pos, t_pos: minimizers that a query (q_id, q_seq) and a target (t_id, t_seq) share; strand 1 is the query's reverse complement."""
    ways = [F.struct(F.lit(0).alias("strand"), F.col("q_seq").alias("seq"))]
    if both_strands:
        ways.append(F.struct(F.lit(1).alias("strand"), reverse_complement("q_seq").alias("seq")))
    q = queries.select("q_id", F.explode(F.array(*ways)).alias("x")).select("q_id", "x.strand", "x.seq")
    q = minimizer_rows(q, "seq", ["q_id", "strand"], k, w).withColumnRenamed("pos", "q_pos").drop("size")
    t = minimizer_rows(targets, "t_seq", ["t_id"], k, w).withColumnRenamed("pos", "t_pos").drop("size")
    return q.join(t, "hash").select("q_id", "t_id", "strand", "q_pos", "t_pos")
