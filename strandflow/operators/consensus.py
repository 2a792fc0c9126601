"""Votes: bases by position, homopolymer lengths, and the fold that rebuilds a sequence from them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote(df: DataFrame, keys: list[str], value: str, n: str | None = None) -> DataFrame:
    """The commonest value by key, the smallest of equals, and its count; a row stands for `n` votes, or for one."""
    counted = df.groupBy(*keys, value).agg((F.sum(n) if n else F.count(F.lit(1))).alias("_n"))
    # min_by of (-count, value): aggregation with partial sums, no window over a hot key
    best = F.min_by(F.struct(F.col(value).alias("value"), "_n"), F.struct(-F.col("_n"), F.col(value)))
    return counted.groupBy(*keys).agg(best.alias("_v")).select(*keys, F.col("_v.value").alias(value), F.col("_v._n").alias("n"))


#: Letters that are counted at once; of a batch's counts up to four times as many are held.
LETTERS = 500_000


def _stretches(texts: pa.Array, most: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(rows, first places, letters) of up to `most` letters in all; a long text is cut."""
    rows, starts, parts, room = [], [], [], most
    for row in range(len(texts)):
        t, at = texts[row].as_py() or "", 0
        while at < len(t):
            part = t[at : at + room]
            rows.append(row)
            starts.append(at)
            parts.append(part)
            at, room = at + len(part), room - len(part)
            if not room:
                yield rows, starts, parts
                rows, starts, parts, room = [], [], [], most
    if rows:
        yield rows, starts, parts


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (values, counts) of several."""
    values, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.flatnonzero(np.diff(values, prepend=-1))
    return values[new], np.add.reduceat(n[order], new)


def position_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 1), ch, n: how often each character stands at each place of the texts of a key.

    Counted in numpy, a bounded number of letters at once, and summed within a
    batch as long as that is bounded too, so that a place is a few rows and not
    one for each text; these counts have yet to be summed.  Null texts count as
    empty.
    """
    kind = df.schema[key].dataType.simpleString()
    most = LETTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            of = ids.indices.to_numpy()
            wide = (pc.max(pc.utf8_length(batch.column(1))).as_py() or 0) + 1

            def shown(packed: np.ndarray, n: np.ndarray, ids: pa.Array = ids, wide: int = wide) -> pa.RecordBatch:
                where, ch = packed // 0x110000, packed % 0x110000
                letters, number = np.unique(ch, return_inverse=True)
                ch = pa.array([chr(c) for c in letters.tolist()], pa.string()).take(pa.array(number))
                cols = [ids.dictionary.take(pa.array(where // wide)), pa.array((where % wide + 1).astype(np.int32)), ch, pa.array(n)]
                return pa.RecordBatch.from_arrays(cols, [key, "pos", "ch", "n"])

            held: list[tuple[np.ndarray, np.ndarray]] = []
            for rows, starts, parts in _stretches(batch.column(1), most):
                size = np.array([len(t) for t in parts])
                codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
                # place in a row of `wide` places for each key
                first = of[rows].astype(np.int64) * wide + starts - (np.cumsum(size) - size)
                held.append(np.unique((np.repeat(first, size) + np.arange(len(codes))) * 0x110000 + codes, return_counts=True))
                if sum(len(x) for x, _ in held) > 4 * most:
                    held = [_merged(held)]
                    if len(held[0][0]) > 2 * most:
                        yield shown(*held.pop())
            if held:
                yield shown(*_merged(held))

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, pos int, ch string, n long")


def length_mode(df: DataFrame, keys: list[str], length: str, reference) -> DataFrame:
    """The commonest length by key if it is strictly commoner than the reference length, else that one.

    Only the two commonest lengths count (the shorter of equals first).
    """
    counted = df.groupBy(*keys, F.col(length).alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_len"))
    at = lambda r: F.max(F.when(F.col("_r") == r, F.struct("_len", "_n")))
    top = counted.withColumn("_r", rank).where("_r <= 2").groupBy(*keys).agg(at(1).alias("_a"), at(2).alias("_b"))
    ref, a, b = F.lit(reference), F.col("_a"), F.col("_b")
    best = F.when(a["_len"] == ref, ref).when((b["_len"] == ref) & (b["_n"] == a["_n"]), ref).otherwise(a["_len"])
    return top.select(*keys, best.alias("length"), a["_n"].alias("n"))


def polymers(seq: str) -> list[tuple[int, int]]:
    """First and last place of the maximal runs of one base."""
    return [(m.start(), m.end() - 1) for m in re.finditer(r"(?s)(.)\1*", seq)]


def read_polymers(draft: str, regions: list[tuple[int, int]], read: str, hit: dict) -> list[tuple[int, str, int]]:
    """(region, text, extra) that a read shows of the runs of a draft it covers from end to end.

    Pairs that have both positions bound a run: what a read inserts beside it
    belongs to it, and where its first or last base is deleted, the next pair
    inside the run stands in; a longer run that has none isn't covered.  Extra
    is 1 if the run is as long as in the draft and the base before it is equal.
    """
    query, ref, i, j = [], [], hit["q_start"], hit["t_start"]
    for n, op in ((int(n), op) for n, op in re.findall(r"([0-9]+)([MID])", hit["cigar"])):
        if op == "M":
            query += range(i, i + n)
            ref += range(j, j + n)
        i, j = i + n * (op != "D"), j + n * (op != "I")
    out = []
    for k, (a, b) in enumerate(regions):
        if a < hit["t_start"] or b >= hit["t_end"]:
            continue
        left, first = bisect_left(ref, a) - 1, bisect_left(ref, a)  # the last pair before the run, the first in or after it
        last, right = bisect_right(ref, b) - 1, bisect_right(ref, b)
        has_a, has_b = first < len(ref) and ref[first] == a, last >= 0 and ref[last] == b
        if a == b and not has_a:
            out.append((k, "", 0))
            continue
        if not has_a and (first >= len(ref) or ref[first] > b) or not has_b and (last < 0 or ref[last] < a):
            continue
        start = query[left] + 1 if has_a and left >= 0 else query[first]
        end = query[right] - 1 if has_b and right < len(ref) else query[last]
        same = end - start == b - a
        out.append((k, read[start : end + 1], int(same and start > 0 and read[start - 1] == draft[a])))
    return out


def recalibrate(regions: list[str], seen: dict[int, list[tuple[str, int]]], longest: int = 20) -> str:
    """A sequence from its homopolymer regions and, for each, the (text, extra length) that reads show, as a list or with counts.

    Regions that are longer than `longest` or unseen are copied.  After a region
    that changes its length, the next region that has a vote is copied too.
    """
    out, skip = [], False
    for i, text in enumerate(regions):
        reads = seen.get(i)
        if len(text) > longest or not reads:
            out.append(text)
            continue
        if skip:
            out.append(text)
            skip = False
            continue
        shown = Counter(reads)
        counts: Counter = Counter()
        for t, extra in sorted(shown):
            counts[len(t) + extra] += shown[t, extra]
        (size, n), *rest = counts.most_common(2)
        if size != len(text) and any(k == len(text) and m == n for k, m in rest):
            size = len(text)
        if size == 0:
            skip = True
            continue
        votes: Counter = Counter()
        for (t, _), n in shown.items():
            if len(t) == size:
                votes[t] += n
        if not votes:
            out.append(text)
            continue
        for at in range(size):
            c: Counter = Counter()
            for t, n in votes.items():
                c[t[at]] += n
            top = max(c.values())
            ref = text[min(at, len(text) - 1)]
            out.append(ref if c[ref] == top else min(b for b, m in c.items() if m == top))
        skip = size != len(text)
    return "".join(out)
