"""CIGAR algebra: sums as Column expressions over arrays of (len, op), walks as vectorised Arrow functions, linear in operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, QUERY, REF = ("M", "=", "X"), ("M", "=", "X", "S", "I"), ("M", "=", "X", "D", "N")
MAPPED = ("M", "I", "D", "=", "X")


def ops(cigar: Column) -> Column:
    """array<struct<len:int, op:string>> of a CIGAR text."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), 1), lambda t: F.struct(F.regexp_extract(t, r"^([0-9]+)", 1).cast("int").alias("len"), F.substring(t, -1, 1).alias("op")))


def sum_of(op: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(op, lambda x: x["op"].isin(*kinds)), F.lit(0), lambda a, x: a + x["len"])


def _is(kinds: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(k) for k in kinds]] = True
    return out


_OP, _DIGIT = _is(("M", "I", "D", "N", "S", "H", "P", "=", "X")), _is(tuple("0123456789"))


class Walk:
    """All operations of an array of CIGAR texts, with what goes before each in its own text."""

    def __init__(self, cigars: pa.Array):
        texts = cigars.cast(pa.large_string()).fill_null("")
        _, offs, raw = texts.buffers()
        off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        off = off - off[0]
        digit = _DIGIT[data]
        after = np.concatenate([[False], digit[:-1]])[: len(data)]
        after[off[:-1][off[:-1] < len(data)]] = False  # what stands before a text isn't its own
        at = np.flatnonzero(_OP[data] & after)
        self.row = np.searchsorted(off, at, "right") - 1
        places = np.flatnonzero(digit)
        op = np.searchsorted(at, places)
        op, places = op[op < len(at)], places[op < len(at)]
        power = at[op] - places - 1
        # digits count while nothing but digits stands between them and the operation
        gaps = np.cumsum(~digit)
        whole = (gaps[at[op] - 1] == gaps[places]) & (off[self.row[op]] <= places)
        self.len = np.bincount(op[whole], (data[places[whole]] - 48.0) * 10.0 ** power[whole], minlength=len(at)).astype(np.int64)
        self.op = data[at]
        self.n = np.bincount(self.row, minlength=len(texts))
        self.first = np.cumsum(self.n) - self.n
        self.index = np.arange(len(at)) - self.first[self.row]

    def before(self, kinds: tuple[str, ...]) -> np.ndarray:
        """The length of operations of these kinds before each operation."""
        own = np.where(_is(kinds)[self.op], self.len, 0)
        sums = np.cumsum(own) - own
        return sums - sums[self.first[self.row]] if len(own) else own

    def total(self, kinds: tuple[str, ...]) -> np.ndarray:
        """By text, the length of operations of these kinds."""
        return np.bincount(self.row, np.where(_is(kinds)[self.op], self.len, 0), minlength=len(self.n)).astype(np.int64)


def _lists(counts: np.ndarray, values: pa.Array, null: pa.Array) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=null if pc.any(null).as_py() else None)


_SEGMENT = ("seg_type", "query_start", "query_end", "ref_position", "left_match", "overhang", "match_len", "order")


def segments(cigar: Column, pos: Column, min_len: int, min_overhang: int = 0) -> Column:
    """Clips and insertions of at least `min_len` and `min_overhang`, with type, query range, reference position, matches to the left and overhang; null without a CIGAR."""

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:int' for n in _SEGMENT)}>>")
    def cut(cigars: pa.Array, positions: pa.Array) -> pa.Array:
        w = Walk(cigars)
        start = positions.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        left, total = w.before(MATCH), w.total(MATCH)[w.row]
        kind = np.where(w.index == 0, 1, np.where(w.index == w.n[w.row] - 1, 4, 2))
        over = np.where(kind == 1, total, np.where(kind == 4, left, np.minimum(left, total - left)))
        query = w.before(QUERY)
        kept = _is(("S", "I"))[w.op] & (w.len >= min_len) & (over >= min_overhang)
        cols = (kind, query, query + w.len, start[w.row] + w.before(REF), left, over, total, w.index)
        values = pa.StructArray.from_arrays([pa.array(c[kept].astype(np.int32)) for c in cols], names=list(_SEGMENT))
        return _lists(np.bincount(w.row[kept], minlength=len(w.n)), values, cigars.is_null())

    return cut(cigar, pos.cast("int"))


def _pairs(w: Walk, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By aligned base without soft clips: text, query and reference position, and whether each of these is there."""
    drawn = np.flatnonzero(_is(("M", "=", "X", "I", "D", "N"))[w.op])
    n = w.len[drawn]
    of = np.repeat(drawn, n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return w.row[of], w.before(QUERY)[of] + k, positions[w.row[of]] + w.before(REF)[of] + k, ~_is(("D", "N"))[w.op[of]], w.op[of] != ord("I")


def aligned_pairs(cigar: Column, pos: Column) -> Column:
    """array<struct<q:int, r:int>>, one for each base of the alignment without soft clips; null for a gap, and without a CIGAR."""

    @F.arrow_udf("array<struct<q:int,r:int>>")
    def pairs(cigars: pa.Array, positions: pa.Array) -> pa.Array:
        w = Walk(cigars)
        row, q, r, has_q, has_r = _pairs(w, positions.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        values = pa.StructArray.from_arrays([pa.array(q.astype(np.int32), mask=~has_q), pa.array(r.astype(np.int32), mask=~has_r)], names=["q", "r"])
        return _lists(np.bincount(row, minlength=len(w.n)), values, cigars.is_null())

    return pairs(cigar, pos.cast("int"))


_TOTALS = ("n", "deleted", "inserted", "q_sum", "r_sum", "qr_sum")


def pair_totals(cigar: Column, pos: Column) -> Column:
    """struct of sums over the aligned pairs, which are not kept: their number, those without query or reference, and sums of positions and their products; without pairs the sums are null."""

    @F.arrow_udf(f"struct<{','.join(f'{n}:bigint' for n in _TOTALS)}>")
    def totals(cigars: pa.Array, positions: pa.Array) -> pa.Array:
        w = Walk(cigars)
        row, q, r, has_q, has_r = _pairs(w, positions.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        n = np.bincount(row, minlength=len(w.n))
        ends = np.cumsum(n)

        def sums(v: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(v)])
            return upto[ends] - upto[ends - n]

        both = has_q & has_r
        found = (n, n - sums(has_q.astype(np.int64)), n - sums(has_r.astype(np.int64)), sums(np.where(has_q, q, 0)), sums(np.where(has_r, r, 0)), sums(np.where(both, q * r, 0)))
        none = (sums(has_q.astype(np.int64)) == 0, sums(has_r.astype(np.int64)) == 0, sums(both.astype(np.int64)) == 0)
        cols = [pa.array(c.astype(np.int64), mask=none[i - 3] if i >= 3 else None) for i, c in enumerate(found)]
        return pa.StructArray.from_arrays(cols, names=list(_TOTALS))

    return totals(cigar, pos.cast("int"))


def nearest_pair(pairs: Column, index: Column, bound: Column, to_left: bool) -> Column:
    """From a place of the list on, to one side, the first aligned pair that has both positions; null if there is none, or if its reference position lies beyond `bound`."""
    ok = lambda x: x["q"].isNotNull() & x["r"].isNotNull()
    if to_left:
        found = F.try_element_at(F.filter(F.slice(pairs, F.lit(1), F.greatest(index + 1, F.lit(0))), ok), F.lit(-1))
        return F.when(found["r"] >= bound, found)
    found = F.try_element_at(F.filter(F.slice(pairs, index + 1, F.size(pairs)), ok), F.lit(1))
    return F.when(found["r"] <= bound, found)


def query_range(cigar: Column, reverse: Column) -> Column:
    """struct<start,end>: the aligned part of the query without soft clips, on its original strand."""
    op = ops(cigar)
    length = sum_of(op, QUERY)
    first, last = F.element_at(op, 1), F.element_at(op, -1)
    lead = F.when(first["op"] == "S", first["len"]).otherwise(0)
    tail = F.when((last["op"] == "S") & (F.size(op) > 1), last["len"]).otherwise(0)
    return F.struct(F.when(reverse, tail).otherwise(lead).alias("start"), (length - F.when(reverse, lead).otherwise(tail)).alias("end"))


def mapped_length(cigar: Column) -> Column:
    return sum_of(ops(cigar), MAPPED)


def divergence(cigar: Column, nm: Column, nn: Column) -> Column:
    return F.try_divide(nm - F.coalesce(nn, F.lit(0)), mapped_length(cigar))
