"""Sequence and interval expressions: trimming, flanks, padding, labels, reverse complement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end), clamped to the sequence."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(seq, lo.cast("int") + 1, F.greatest(F.least(end, F.length(seq)) - lo, F.lit(0)).cast("int"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def trim_region(start: Column, end: Column, length: Column, flank: int = 3000) -> Column:
    return F.struct(F.greatest(start - flank, F.lit(0)).alias("start"), F.least(end + flank, length).alias("end"))


def flanks(seq: Column, start: Column, end: Column, size: int = 500) -> Column:
    """struct<left,right>: `size` bases that end at `start` (inclusive), and that begin at `end`."""
    return F.struct(sub(seq, start - (size - 1), start + 1).alias("left"), sub(seq, end, end + size).alias("right"))


def joined_ends(left: Column, right: Column, gap: int = 500) -> Column:
    return F.concat(left, F.repeat(F.lit("N"), gap), right)


def padded(seq: Column, left_mapped: Column, right_mapped: Column, pad: int = 50) -> Column:
    """An insertion that one flank bounds is open on the other side: N marks it."""
    n = F.repeat(F.lit("N"), pad)
    return F.when(left_mapped, F.concat(seq, n)).when(right_mapped, F.concat(n, seq)).otherwise(seq)


def without_n(seq: Column) -> Column:
    return F.regexp_replace(seq, "N", "")


def query_region(reverse: Column, start: Column, end: Column, extra: Column | None = None) -> Column:
    """strand:start-end, with what lies before the sequence in brackets."""
    before = F.lit("") if extra is None else F.when(extra > 0, F.concat(F.lit("("), extra.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.when(reverse, "-").otherwise("+"), F.lit(":"), before, start.cast("string"), F.lit("-"), end.cast("string"))


def target_region(kind: Column, name: Column, start: Column, end: Column) -> Column:
    return F.when(kind == "TE", F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(kind)


def extra_length(prior: Column, base: Column) -> Column:
    """1 if the base before a homopolymer equals it."""
    return F.when(F.upper(prior) == F.upper(base), 1).otherwise(0)


def min_edge(n: Column, override: int = 0) -> Column:
    """Edge coverage that an assembly asks for, by the number of segments."""
    if override > 0:
        return F.lit(override)
    return F.when(n < 5, 1).when(n < 10, 2).when(n < 40, 3).when(n < 70, 4).otherwise(5)
