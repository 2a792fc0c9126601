"""Annotation of assembled insertions: bounds from flanks, element records, target site duplications, structure bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import flags
from ..functions import sequences as sq
from ..operators.merge import sign


def tsd(ref_start: Column, ref_end: Column, left_end: Column, right_start: Column, near=50, longest=50) -> Column:
    """struct<code,tsd,start,end>: left_end and right_start are where the insertion's ends align, or null.

    An end counts if it lies within `near` of the middle of the cluster.  Code 3
    means both, 1 only the left, 2 only the right, 0 none, and then the span of
    the cluster stays.
    """
    mid = F.floor((ref_start + ref_end) / 2)
    a = F.coalesce(F.abs(left_end - mid) <= near, F.lit(False))
    b = F.coalesce(F.abs(right_start - mid) <= near, F.lit(False))
    both = a & b
    return F.struct(
        F.when(both, 3).when(a, 1).when(b, 2).otherwise(0).alias("code"),
        F.coalesce(both & (right_start < left_end) & (left_end - right_start < longest), F.lit(False)).alias("tsd"),
        F.when(both, F.least(left_end, right_start)).when(a, left_end - 1).when(b, right_start - 1).otherwise(ref_start).alias("start"),
        F.when(both, F.greatest(left_end, right_start)).when(a, left_end).when(b, right_start).otherwise(ref_end).alias("end"),
    )


def region_bits(tid1: Column, tid2: Column, left_most: Column, right_most: Column, clip1: Column, clip2: Column, big: int = 400, least: int = 100) -> Column:
    """Which flanks of an insertion an assembly holds, as flag bits; the first rule that fits decides."""
    big1, big2 = F.coalesce(clip1 > big, F.lit(False)), F.coalesce(clip2 > big, F.lit(False))
    left, right = F.lit(flags.BIT["LEFT_FLANK_MAP"]), F.lit(flags.BIT["RIGHT_FLANK_MAP"])
    return (
        F.when(tid1.isNull() & tid2.isNull(), 0).when(big1 & big2, 0).when(tid2.isNull(), left).when(tid1.isNull(), right).when(big2, left).when(big1, right)
        .when((tid1 == tid2) & (left_most <= right_most - least), F.lit(flags.BIT["SAME_FLANK_MAP"])).when(tid1 != tid2, F.lit(flags.BIT["DIFF_FLANK_MAP"])).otherwise(0)
    ).cast("long")


def element_bits(ref_start: Column, ref_end: Column, te_len: Column, te_tid: Column, rep_tid: Column) -> Column:
    """Full ends of one element annotation, and whether it is the element that is there already."""
    slack = F.floor(F.least(te_len * 0.08, F.lit(100.0)))
    return flags.bits_if(_5P_FULL=ref_start < slack, _3P_FULL=te_len - ref_end < slack, SELF_TO_SELF=F.coalesce(te_tid == rep_tid, F.lit(False)))


def _near(te_len: Column) -> Column:
    return F.greatest(te_len * 0.2, F.lit(100.0))


def structure_bits(rows: Column, ins_len: Column, flag: Column, at_left: Column, at_right: Column) -> Column:
    """Structure bits of an insertion.

    `rows` is array<struct<start,end,kind,reverse,bits,te_len,cls>> ordered by
    start and end; kind is TE, PolyA or PolyT.  at_left and at_right say whether
    the flanks hold a run of T or A next to the insertion.
    """
    first, last, n = F.try_element_at(rows, F.lit(1)), F.try_element_at(rows, F.lit(-1)), F.size(rows)
    lft = F.try_element_at(F.filter(rows, lambda r: r["kind"] != "PolyT"), F.lit(1))
    rgt = F.try_element_at(F.filter(rows, lambda r: r["kind"] != "PolyA"), F.lit(-1))
    yes = lambda c: F.coalesce(c, F.lit(False))
    five, three = (lambda r: yes(flags.has(r["bits"], "5P_FULL"))), (lambda r: yes(flags.has(r["bits"], "3P_FULL")))
    rev_l, rev_r = yes(lft["reverse"]), yes(rgt["reverse"])
    is_te_l, is_te_r = yes(lft["kind"] == "TE"), yes(rgt["kind"] == "TE")
    fwd_l, fwd_r = is_te_l & ~rev_l, is_te_r & ~rev_r
    retro = lambda r: yes(flags.has(r["cls"], *flags.RETRO))
    # the tails next to the outermost elements: the last T before the first one, the first A behind the last one
    place = F.array_position(F.transform(rows, lambda r: r["kind"] != "PolyT"), True).cast("int")
    behind = F.array_position(F.reverse(F.transform(rows, lambda r: r["kind"] != "PolyA")), True).cast("int")
    before, after = F.try_element_at(rows, F.when(place > 1, place - 1)), F.try_element_at(rows, F.when(behind > 1, 1 - behind))
    head = (first["kind"] == "PolyT") & three(lft) & (lft["start"] - before["end"] < 20) & (first["start"] < 100)
    tail = (last["kind"] == "PolyA") & three(rgt) & (after["start"] - rgt["end"] < 20) & (ins_len - last["end"] < 100)
    poly = (n >= 2) & (yes(head) | yes(tail))
    full5 = (fwd_l & five(lft)) | (rev_r & five(rgt))
    full3 = (rev_l & three(lft)) | (fwd_r & three(rgt))
    left_only, right_only = flags.has(flag, "LEFT_FLANK_MAP"), flags.has(flag, "RIGHT_FLANK_MAP")
    return flags.bits_if(
        LEFT_NEAR_END=yes(first["start"] < _near(lft["te_len"])), RIGHT_NEAR_END=yes(ins_len - last["end"] < _near(rgt["te_len"])), POLYA=poly, _5P_FULL=full5, _3P_FULL=full3,
        _5P_UNKNOWN=~full5 & ((fwd_l & right_only) | (rev_r & left_only)), _3P_UNKNOWN=~full3 & ((rev_l & right_only) | (fwd_r & left_only)),
        AT_RICH=~poly & ((at_left & rev_l & three(lft) & retro(lft)) | (at_right & fwd_r & three(rgt) & retro(rgt))),
    )


def solo_ltr(is_ltr: Column, single: Column, ref_start: Column, ref_end: Column, te_len: Column, ltr_len: Column, slack: int = 20) -> Column:
    """The insertion is one long terminal repeat, of the left or the right end."""
    left = (ref_start <= slack) & (F.abs(ref_end - ltr_len) <= slack)
    right = (F.abs(ref_start - (te_len - ltr_len)) <= slack) & (F.abs(ref_end - te_len) <= slack)
    return is_ltr & single & (ltr_len > 0) & (left | right)


def outermost(elements: Column) -> Column:
    """struct<first,last>: of elements in order the first, and the first of those that end last."""
    first = F.try_element_at(elements, F.lit(1))
    last = F.aggregate(elements, first, lambda acc, x: F.when(x["end"] > acc["end"], x).otherwise(acc))
    return F.struct(first.alias("first"), last.alias("last"))


def insertion_class(first: Column, last: Column) -> Column:
    """The class of that of the outermost elements which covers more of its element, the last of equals."""
    return F.when(first["ref_end"] - first["ref_start"] > last["ref_end"] - last["ref_start"], first["cls"]).otherwise(last["cls"])


def strand(elements: Column) -> Column:
    """Which strand more elements lie on."""
    return sign(F.aggregate(elements, F.lit(0), lambda a, e: a + F.when(e["reverse"], -1).otherwise(1)))


def shifted(rows: Column, delta: Column) -> Column:
    """The rows with start and end moved."""
    return F.transform(rows, lambda r: r.withField("start", r["start"] + delta).withField("end", r["end"] + delta))


def query_regions(rows: Column) -> Column:
    """All rows as strand:start-end, comma-joined; a PolyT that begins before the sequence starts at 0 and shows by how much it is longer."""

    def one(r: Column) -> Column:
        before = F.when((r["kind"] == "PolyT") & (r["start"] < 0), -r["start"]).otherwise(0)
        return sq.query_region(F.coalesce(r["reverse"], r["kind"] == "PolyT"), r["start"] + before, r["end"], before)

    return F.array_join(F.transform(rows, one), ",")


def target_regions(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: sq.target_region(r["kind"], r["name"], r["ref_start"], r["ref_end"])), ",")


def flank_hit(hits: Column) -> Column:
    """Of a flank's alignments, in order, that with the shortest clip on the side of the insertion, the last of equals."""
    return F.aggregate(hits, F.try_element_at(hits, F.lit(1)), lambda acc, x: F.when(x["clip"] <= acc["clip"], x).otherwise(acc))


def insertion_sequence(flag: Column, left: Column, right: Column, left_most: Column, right_most: Column) -> Column:
    """What lies between the flanks on their contigs: up to a contig's end where only one flank is known, and with N between the ends of two contigs."""
    to_end, from_start = sq.sub(left, left_most, F.length(left)), sq.sub(right, F.lit(0), right_most)
    return (
        F.when(flags.has(flag, "LEFT_FLANK_MAP"), to_end).when(flags.has(flag, "RIGHT_FLANK_MAP"), from_start)
        .when(flags.has(flag, "SAME_FLANK_MAP"), sq.sub(left, left_most, right_most)).when(flags.has(flag, "DIFF_FLANK_MAP"), sq.joined_ends(to_end, from_start))
    )


def flank_sequences(flag: Column, left: Column, right: Column, left_most: Column, right_most: Column, size: int = 500) -> Column:
    """struct<upstream,downstream>: contig beside the insertion, or '.' on a side that no flank bounds."""
    return F.struct(
        F.when(flags.has(flag, "RIGHT_FLANK_MAP"), F.lit(".")).otherwise(sq.sub(left, left_most - size, left_most)).alias("upstream"),
        F.when(flags.has(flag, "LEFT_FLANK_MAP"), F.lit(".")).otherwise(sq.sub(right, right_most, right_most + size)).alias("downstream"),
    )


def contig_ends(flag: Column, contig: Column, left_most: Column, right_most: Column, size: int = 200, least: int = 250) -> Column:
    """struct<left,right>: of an insertion that one flank bounds, contig at both of its ends, to be looked for in the reference; null if it is shorter than `least`."""
    n, left = F.length(contig), flags.has(flag, "LEFT_FLANK_MAP")
    long_enough = F.when(left, n - left_most).otherwise(right_most) >= least
    a = F.when(left, sq.sub(contig, left_most - size, left_most)).otherwise(sq.sub(contig, F.lit(0), F.lit(size)))
    b = F.when(left, sq.sub(contig, n - size, n)).otherwise(sq.sub(contig, right_most, right_most + size))
    return F.when(flags.has(flag, "LEFT_FLANK_MAP", "RIGHT_FLANK_MAP") & long_enough, F.struct(a.alias("left"), b.alias("right")))


def reset_one_flank(flag: Column, left: Column, right: Column, local_start: Column, ref_start: Column, ref_end: Column, contig_len: Column, left_most: Column, right_most: Column, near: int = 50) -> Column:
    """struct<flag,left_most,right_most> of an insertion that one flank bounds, after its contig's ends were aligned to the reference.

    left and right are struct<end,clip_out,last,size> and struct<start,clip_out,first,size>
    of these alignments in local coordinates, or null: clip_out is the clip away
    from the insertion, last and first the length of the operation towards it.
    Both ends have to lie beside the breakpoint and each other; then both flanks
    are known, and the insertion ends where the alignment does.
    """
    off = lambda at: F.least(F.abs(at + local_start - ref_start), F.abs(at + local_start - ref_end))
    ok = (
        flags.has(flag, "LEFT_FLANK_MAP", "RIGHT_FLANK_MAP") & (left["end"] > 0) & (right["start"] > 0) & (left["clip_out"] <= near) & (right["clip_out"] <= near)
        & (off(left["end"]) <= near) & (off(right["start"]) <= near) & (F.abs(right["start"] - left["end"]) <= near)
    )
    ok = F.coalesce(ok, F.lit(False))
    cleared = flag.bitwiseAND(F.lit(~flags.mask("LEFT_FLANK_MAP", "RIGHT_FLANK_MAP")).cast("long")).bitwiseOR(F.lit(flags.BIT["SAME_FLANK_MAP"]).cast("long"))
    return F.struct(
        F.when(ok, cleared).otherwise(flag).alias("flag"),
        F.when(ok & flags.has(flag, "RIGHT_FLANK_MAP"), left["size"] - left["last"]).otherwise(left_most).alias("left_most"),
        F.when(ok & flags.has(flag, "LEFT_FLANK_MAP"), contig_len - (right["size"] - right["first"])).otherwise(right_most).alias("right_most"),
    )
