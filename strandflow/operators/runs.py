"""Runs along a sequence: homopolymers and maximal scoring runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_texts(seq: Column) -> Column:
    """The maximal runs of one character, which together are the sequence."""
    return F.regexp_extract_all(seq, F.lit(r"(?s)((.)\2*)"), 1)


def run_lengths(seq: Column) -> Column:
    """array<struct<base,len>> in order."""
    return F.transform(run_texts(seq), lambda r: F.struct(F.substring(r, 1, 1).alias("base"), F.length(r).alias("len")))


def scoring_runs(seq: str, target: str = "A", other: str = "T", least: int = 5, rate: float = 0.01, restart: int = 10) -> list[tuple[int, int]]:
    """(last position, length) of runs rich in `target`.

    The target scores 1, `other` -1 and anything else -3.  A run is its best
    prefix; it is given out when the score falls below zero or more than
    `restart` characters miss, if it is at least `least` long and such a run
    would be rare by chance.
    """
    out: list[tuple[int, int]] = []
    n = len(seq)
    begin, score, top, best, misses = 0, 0, 0, -1, 0

    def give() -> None:
        size = best - begin + 1
        if best >= begin and size >= least and (n - size + 1) * 0.25**size <= rate:
            out.append((best, size))

    for i, c in enumerate(seq):
        if c == target:
            score += 1
        else:
            score -= 1 if c == other else 3
            misses += 1
        if score > top:
            top, best = score, i
        if score < 0 or misses > restart:
            give()
            begin, score, top, best, misses = i + 1, 0, 0, i, 0
    give()
    return out


def with_scoring_runs(df: DataFrame, seq: str, target: str = "A", other: str = "T") -> DataFrame:
    """The rows with `runs`: array<struct<end,len>> of their sequence."""
    names, at = df.columns, df.columns.index(seq)
    kind = pa.list_(pa.struct([("end", pa.int32()), ("len", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [None if (s := t.as_py()) is None else [{"end": e, "len": k} for e, k in scoring_runs(s, target, other)] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, kind)], [*names, "runs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, runs array<struct<end:int,len:int>>")


def flank_run(seq: str, base: str, at_end: bool, gap: int = 5, strict_compat: bool = False) -> bool:
    """Whether a flank has a run of `base` that lies within `gap` of the insertion (at the flank's end, or its start).

    `strict_compat` measures the gap of a run at the start by its last position,
    which lets only the shortest runs through.
    """
    runs = scoring_runs(seq if not at_end else seq[::-1], base, "T" if base == "A" else "A")
    if not runs:
        return False
    end, size = max(runs, key=lambda r: r[1])
    return (end if strict_compat and not at_end else end - size + 1) <= gap


def with_flank_runs(df: DataFrame, seq: str, size: int, base: str = "A", end_base: str = "T") -> DataFrame:
    """The rows with `at_start` and `at_end`: whether a run of either base lies next to that end, within its `size` characters; null without a sequence."""
    names, at = df.columns, df.columns.index(seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            start = [None if t is None else flank_run(t[:size], base, False) for t in texts]
            end = [None if t is None else flank_run(t[-size:], end_base, True) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.bool_()), pa.array(end, pa.bool_())], [*names, "at_start", "at_end"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, at_start boolean, at_end boolean")
