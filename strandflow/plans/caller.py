"""The whole dataflow: alignments to genotyped, annotated insertions in one 16-column table.

Each stage is a function from tables to a table; nothing is collected but the
one row of background statistics.  Input tables:

contigs(tid, name, length), refs(tid, name, seq), te(te_tid, name, te_class, class_bit, length, seq, ltr_len),
alignments(aln_id, qname, flag, tid, pos, mapq, cigar, nm, nn, aln_score, read_len), reads(aln_id, qname, seq),
intervals(contig, start, end, name, kind, rep_tid).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import flags, scoring
from ..functions.scoring import Scorer
from ..functions import sequences as sq
from ..lineage import Scratch
from ..operators import assembly, chains, clusters, cover, intervals, merge, seqjoin
from ..operators.runs import flank_run, scoring_runs
from ..sources.text import tiles
from . import annotate as an


@dataclass(frozen=True)
class CallerConfig:
    min_seg_len: int = 100
    max_dist: int = 50
    overhang: int = 200
    min_edge: int = 0
    node_len: int = 256
    location_slack: int = 50
    blacklist_slack: int = 2
    min_te_frac: float = 0.8
    read_flank: int = 3000
    span_margin: int = 75
    bin_width: int = 1 << 20
    seed: int = 11
    #: Logistic weights of the two models: clusters of several reads, and the rest.
    high: dict = field(default_factory=lambda: {"num_seg_raw": 0.3, "mean_query_map_frac": 2.0, "low_map_qual_frac": -3.0})
    low: dict = field(default_factory=lambda: {"mean_query_map_frac": 2.5, "low_map_qual_frac": -3.0})
    high_bias: float = -1.0
    low_bias: float = -1.0

    def __post_init__(self):
        if self.node_len % 256:
            raise ValueError("node_len has to be a multiple of 256")
        if min(self.min_seg_len, self.max_dist, self.overhang) < 0 or not self.min_seg_len:
            raise ValueError("lengths and distances have to be positive")


@dataclass
class Tables:
    contigs: DataFrame
    refs: DataFrame | None
    te: DataFrame
    alignments: DataFrame
    reads: DataFrame
    intervals: DataFrame
    #: (tid, tile, offset, seq) of TILE bases and 4 * FLANK more, in place of refs.
    tiles: DataFrame | None = None


KEYS = ["tid", "idx"]
#: Bases beside a breakpoint; bases of a tile of a contig, which overlaps the next one by 4 * FLANK.
FLANK, TILE = 500, 65_536


def cut(df: DataFrame, name: str) -> DataFrame:
    return Scratch(df.sparkSession, "caller").cut(df, name)


#: Alignment flags that make a record invalid (unmapped, secondary), and those that a consensus leaves out (duplicate and supplementary ones too).
INVALID, UNCLEAN = 0x104, 0xD04


def is_valid(flag: Column, drop: int = INVALID) -> Column:
    return flag.bitwiseAND(F.lit(drop)) == 0


def valid(alignments: DataFrame) -> DataFrame:
    """Neither unmapped nor secondary; supplementary alignments stay."""
    return alignments.where(is_valid(F.col("flag")))


def background(t: Tables) -> tuple[float, float, float]:
    """Mean divergence, depth and median read length of the longest contig (the first of equals)."""
    longest = t.contigs.agg(F.max_by(F.struct("tid", "length"), F.struct("length", -F.col("tid"))).alias("c")).select("c.*")
    rows = valid(t.alignments).join(F.broadcast(longest), "tid")  # one row
    rows = rows.select("tid", "length", "read_len", cg.divergence(F.col("cigar"), F.col("nm"), F.col("nn")).alias("div"), cg.mapped_length(F.col("cigar")).alias("mapped"))
    row = clusters.background(rows, "tid", "length", "div", "read_len", "mapped").first()
    if row["bg_depth"] is None:
        raise ValueError("no valid alignments on the longest contig")
    return float(row["bg_div"] or 0.0), float(row["bg_depth"]), float(row["bg_read_len"])


def segments(t: Tables, cfg: CallerConfig) -> DataFrame:
    """Clips and insertions with location types, as rows of their alignment."""
    a = valid(t.alignments).withColumn("segs", cg.segments(F.col("cigar"), F.col("pos"), cfg.min_seg_len)).where(F.size("segs") > 0)
    a = a.withColumn("aln_type", F.aggregate("segs", F.lit(0), lambda x, s: x.bitwiseOR(s["seg_type"]))).withColumn("refend", F.col("pos") + cg.sum_of(cg.ops(F.col("cigar")), cg.REF))
    marks = t.intervals.where("kind in ('repeat', 'gap')").join(t.contigs.select("tid", F.col("name").alias("contig")), "contig").select("tid", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    ends = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("at")) for c in ("pos", "refend"))))
    near = intervals.point_overlaps(a.select("tid", "aln_id", ends.alias("x")).select("tid", "aln_id", "x.*"), marks, "tid", "at", ["aln_id", "side"], cfg.location_slack, 4096)
    kind = intervals.location_type(F.col("n"), F.col("min_dist"), cfg.location_slack)
    kinds = near.groupBy("aln_id").agg(*(F.max(F.when(F.col("side") == c, kind)).alias(f"loc_{c}") for c in ("pos", "refend")))
    a = a.join(kinds, "aln_id").withColumn("aln_location_type", intervals.alignment_location(F.col("loc_pos"), F.col("loc_refend")))
    s = a.select("aln_id", "qname", "tid", F.col("mapq").alias("map_qual"), "read_len", "aln_type", "aln_location_type", F.col("pos").alias("aln_refstart"), F.col("refend").alias("aln_refend"), F.explode("segs").alias("s"))
    names = ("seg_type", "query_start", "query_end", "ref_position", "left_match", "overhang", "match_len", "order")
    return s.select("*", *(F.col(f"s.{n}").alias(n) for n in names)).withColumn("seg_id", F.col("aln_id") * 65536 + F.col("order")).drop("s").where(F.col("overhang") >= cfg.overhang)


def te_alignments(segs: DataFrame, t: Tables, cfg: CallerConfig) -> DataFrame:
    q = segs.join(t.reads.select("aln_id", "seq"), "aln_id").select(F.col("seg_id").cast("string").alias("q_id"), sq.sub(F.col("seq"), F.col("query_start"), F.col("query_end")).alias("q_seq"))
    hits = chains.align(cut(q, "segment_seqs"), t.te.select(F.col("te_tid").cast("string").alias("t_id"), F.col("seq").alias("t_seq")), cfg.seed)
    return hits.select(F.col("q_id").cast("long").alias("seg_id"), F.col("t_id").cast("int").alias("te_tid"), F.col("score").alias("aln_score"), F.col("q_start").alias("query_start"), F.col("q_end").alias("query_end"),
                       cg.mapped_length(F.col("cigar")).alias("map_len"), cg.divergence(F.col("cigar"), F.col("nm"), F.lit(0)).alias("divergence"))


def build(t: Tables, cfg: CallerConfig, high: Column | Scorer | None = None, low: Column | Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters with features, probability and quality; segments with their cluster); models are Columns or batch models."""
    div, depth, length = background(t)
    segs = segments(t, cfg)
    rolled = cover.roll_up(te_alignments(segs, t, cfg))
    segs = segs.join(rolled, "seg_id", "left").withColumns({"num_te_aln": F.coalesce("num_te_aln", F.lit(0)), "sum_query_maplen": F.coalesce("sum_query_maplen", F.lit(0))})
    order = ["map_qual", "query_start", "query_end", "seg_type", "aln_type", "seg_id"]
    segs = cut(clusters.gap_cluster(segs, ["tid"], "ref_position", cfg.max_dist, order, bin_width=cfg.bin_width), "segments")
    c = clusters.features(segs, KEYS, div, depth, length).where(F.col("te_aligned_frac") >= cfg.min_te_frac)
    named = t.intervals.join(t.contigs.select("tid", F.col("name").alias("contig")), "contig").select("tid", F.col("start").alias("i_start"), F.col("end").alias("i_end"), "rep_tid", "kind")
    spans = c.select("tid", "idx", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    over = intervals.interval_overlaps(spans, named.where("kind in ('repeat', 'gap')").drop("kind").withColumn("rep", F.col("rep_tid")), "tid", KEYS, cfg.location_slack, 4096, "rep")
    repeat = intervals.interval_overlaps(spans, named.where("kind = 'repeat'").drop("kind").withColumn("rep", F.col("rep_tid")), "tid", KEYS, cfg.location_slack, 4096, "rep")
    black = intervals.semi(spans, named.where("kind = 'blacklist'").drop("kind"), "tid", KEYS, cfg.blacklist_slack, 4096).select(*KEYS, F.lit(True).alias("is_in_blacklist"))
    c = c.join(over.select(*KEYS, intervals.location_type(F.col("n"), F.col("min_dist"), cfg.location_slack).alias("location_type")), KEYS).join(repeat.select(*KEYS, F.col("rep").alias("rep_tid")), KEYS)
    c = c.join(black, KEYS, "left").withColumn("is_in_blacklist", F.coalesce("is_in_blacklist", F.lit(False)))
    c = scoring.gated(c, high if high is not None else scoring.logistic(cfg.high, cfg.high_bias), low if low is not None else scoring.logistic(cfg.low, cfg.low_bias), keys=KEYS)
    return c.withColumn("low_quality", clusters.is_low_quality(F.col("is_in_blacklist"), F.col("probability"), F.col("num_seg"))), segs


def assemblies(good: DataFrame, segs: DataFrame, t: Tables, cfg: CallerConfig) -> DataFrame:
    """KEYS, contigs: one contig a cluster, or two (left flank, right flank) where reads clip on both sides and none spans.

    Clusters of a single read, and those whose reads don't make a contig, keep the representative read.
    """
    low = clusters.is_low_frequency(F.col("clt_type"))
    two = ~low & (F.col("num_middle") == 0) & (F.col("num_left") > 0) & (F.col("num_right") > 0)
    contig = F.when(F.col("_two") & (F.col("seg_type") == flags.LEFT_CLIP), 1).otherwise(0).alias("contig")
    s = segs.join(good.select(*KEYS, "rep_seg_id", two.alias("_two"), low.alias("_low")), KEYS).where(~F.col("_low") | (F.col("seg_id") == F.col("rep_seg_id"))).select("*", contig)
    longest = F.struct(F.col("seg_id") == F.col("rep_seg_id"), F.col("query_end") - F.col("query_start"), -F.col("seg_id"))
    reps = s.groupBy(*KEYS, "contig").agg(F.max_by("seg_id", longest).alias("_rep"))
    s = s.join(reps, [*KEYS, "contig"]).join(t.reads.select("aln_id", "seq"), "aln_id")
    region = sq.trim_region(F.col("query_start"), F.col("query_end"), F.length("seq"), cfg.read_flank)
    rows = s.select(*KEYS, "contig", "seg_id", (F.col("seg_id") == F.col("_rep")).alias("is_rep"), region.alias("r"), "seq", "_low").select(*KEYS, "contig", "seg_id", "is_rep", sq.sub(F.col("seq"), F.col("r.start"), F.col("r.end")).alias("seq"), "_low")
    rows = cut(rows, "reads")
    done = assembly.assemble(rows.where("not _low").drop("_low"), [*KEYS, "contig"], edge=cfg.min_edge, node_len=cfg.node_len)
    done = done.unionByName(rows.where("_low").select(*KEYS, "contig", F.col("seq").alias("assembly"), F.lit(False).alias("is_assembled")))
    return done.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("contig", "assembly", "is_assembled"))).alias("contigs"))  # at most two


def _clip(cigar: Column, last: bool) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"([0-9]+)S$" if last else r"^([0-9]+)S", 1).try_cast("int"), F.lit(0))


def _reference(c: DataFrame, t: Tables, at: Column) -> DataFrame:
    """The rows with the tile of their contig that holds `at` and what follows, and where it begins."""
    parts = (t.tiles if t.tiles is not None else tiles(t.refs, TILE, 4 * FLANK, "tid")).select("tid", F.col("tile").alias("_tile"), F.col("offset").alias("ref_offset"), F.col("seq").alias("ref_seq"))
    return c.withColumn("_tile", F.floor(at / TILE).cast("int")).join(parts, ["tid", "_tile"]).drop("_tile")


def insertions(good: DataFrame, assembled: DataFrame, t: Tables) -> DataFrame:
    """Clusters with their contigs, bounds of the insertion on them, region bits, insertion and flank sequences."""
    lo = F.greatest(F.col("ref_mode") - FLANK, F.lit(0))
    c = _reference(good.join(assembled, KEYS), t, lo)
    at = F.col("ref_mode") - F.col("ref_offset")
    f = sq.flanks(F.col("ref_seq"), at, at, FLANK)
    c = c.withColumns({"left_flank": f["left"], "right_flank": f["right"], "local_start": lo, "local": sq.sub(F.col("ref_seq"), lo - F.col("ref_offset"), at + FLANK)}).drop("ref_seq", "ref_offset")
    contig = lambda i: F.try_element_at("contigs", F.lit(i + 1))["assembly"]
    c = c.withColumns({"a0": contig(0), "a1": contig(1), "is_assembled": F.exists("contigs", lambda x: x["is_assembled"])}).drop("contigs")
    c = seqjoin.align_pairs(c, {"l0": ("left_flank", "a0"), "r0": ("right_flank", "a0"), "l1": ("left_flank", "a1"), "r1": ("right_flank", "a1")})
    hit = lambda side, i: F.when(F.col(f"{side}{i}").isNotNull(), F.struct(F.lit(i).alias("contig"), _clip(F.col(f"{side}{i}.cigar"), side == "l").alias("clip"), F.col(f"{side}{i}").alias("x")))
    best = lambda side: an.flank_hit(F.filter(F.array(hit(side, 0), hit(side, 1)), lambda x: x.isNotNull()))
    c = c.withColumns({"la": best("l"), "ra": best("r")}).drop("l0", "r0", "l1", "r1")
    # the flank that touches the insertion must be aligned there, up to a short clip on that side
    c = c.withColumns({"tid1": F.col("la.contig"), "tid2": F.col("ra.contig"), "left_most": F.col("la.x.t_end"), "right_most": F.col("ra.x.t_start")})
    region = an.region_bits(F.col("tid1"), F.col("tid2"), F.col("left_most"), F.col("right_most"), _clip(F.col("la.x.cigar"), False), _clip(F.col("ra.x.cigar"), True))
    own = lambda tid: F.when(F.col(tid) == 1, F.col("a1")).when(F.col(tid) == 0, F.col("a0"))
    c = c.withColumns({"flag": region + F.when(F.col("is_assembled"), F.lit(flags.BIT["ASSEMBLED"])).otherwise(F.lit(0)).cast("long"), "left_asm": own("tid1"), "right_asm": own("tid2")}).drop("a0", "a1", "la", "ra")
    c = _rescued(c.where(flags.has(F.col("flag"), "LEFT_FLANK_MAP", "RIGHT_FLANK_MAP", "DIFF_FLANK_MAP", "SAME_FLANK_MAP")))
    bounds = (F.col("flag"), F.col("left_asm"), F.col("right_asm"), F.col("left_most"), F.col("right_most"))
    beside = an.flank_sequences(*bounds, FLANK)
    return c.withColumns({"ins_seq": an.insertion_sequence(*bounds), "upstream": beside["upstream"], "downstream": beside["downstream"]}).where(F.length("ins_seq") > 0)


def _rescued(c: DataFrame) -> DataFrame:
    """Insertions that one flank bounds, whose contig's other end may lie beside the breakpoint too."""
    left = flags.has(F.col("flag"), "LEFT_FLANK_MAP")
    one = F.when(left, F.col("left_asm")).when(flags.has(F.col("flag"), "RIGHT_FLANK_MAP"), F.col("right_asm"))
    c = c.withColumn("one", one).withColumn("ends", an.contig_ends(F.col("flag"), F.col("one"), F.col("left_most"), F.col("right_most")))
    c = seqjoin.align_pairs(c.withColumns({"end_l": F.col("ends.left"), "end_r": F.col("ends.right")}).drop("ends"), {"el": ("end_l", "local"), "er": ("end_r", "local")})
    first, last = (lambda x: F.regexp_extract(x, r"^([0-9]+)", 1).try_cast("int")), (lambda x: F.regexp_extract(x, r"([0-9]+)[A-Z=]$", 1).try_cast("int"))
    a = F.when(F.col("el").isNotNull(), F.struct(F.col("el.t_end").alias("end"), _clip(F.col("el.cigar"), False).alias("clip_out"), last(F.col("el.cigar")).alias("last"), F.length("end_l").alias("size")))
    b = F.when(F.col("er").isNotNull(), F.struct(F.col("er.t_start").alias("start"), _clip(F.col("er.cigar"), True).alias("clip_out"), first(F.col("er.cigar")).alias("first"), F.length("end_r").alias("size")))
    c = c.withColumn("reset", an.reset_one_flank(F.col("flag"), a, b, F.col("local_start"), F.col("ref_start"), F.col("ref_end"), F.length("one"), F.col("left_most"), F.col("right_most")))
    both = F.col("reset.flag") != F.col("flag")
    new = {"left_asm": F.when(both, F.col("one")).otherwise(F.col("left_asm")), "right_asm": F.when(both, F.col("one")).otherwise(F.col("right_asm")), "left_most": F.col("reset.left_most"), "right_most": F.col("reset.right_most")}
    return c.withColumns(new).withColumn("flag", F.col("reset.flag")).drop("one", "end_l", "end_r", "el", "er", "reset")


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of A behind the last and of T before the first element, and whether the flanks have such runs."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            te = [x.asDict() if hasattr(x, "asDict") else x for x in r.elements]
            rows, first, last = [], min(te, key=lambda x: x["start"]), max(te, key=lambda x: x["end"])
            retro = lambda x: bool(x["cls"] & flags.mask(*flags.RETRO))
            if first["start"] >= 5 and first["reverse"] and retro(first):
                head = r.ins_seq[: first["start"]][::-1]
                rows += [{"start": len(head) - 1 - e, "end": len(head) - 1 - e + k, "kind": "PolyT"} for e, k in scoring_runs(head, "T", "A")]
            tail = r.ins_seq[last["end"] :]
            if len(tail) >= 5 and not last["reverse"] and retro(last):
                rows += [{"start": last["end"] + e - k + 1, "end": last["end"] + e + 1, "kind": "PolyA"} for e, k in scoring_runs(tail, "A", "T")]
            out.append((r.tid, r.idx, rows, flank_run(r.upstream[-20:], "T", True), flank_run(r.downstream[:20], "A", False)))
        yield pd.DataFrame(out, columns=["tid", "idx", "tails", "at_left", "at_right"])


ROW = "struct<start:int,end:int,kind:string,reverse:boolean,bits:bigint,te_len:int,cls:bigint,te_tid:int,ref_start:int,ref_end:int,score:int,name:string,ltr_len:int>"


def annotated(ins: DataFrame, t: Tables, cfg: CallerConfig) -> DataFrame:
    """Element, PolyA and PolyT rows of each insertion, structure bits and class; insertions without an element go."""
    ins = ins.withColumn("insertion_id", F.concat_ws("-", F.col("tid").cast("string"), F.col("idx").cast("string")))
    hits = chains.align(ins.select(F.col("insertion_id").alias("q_id"), F.col("ins_seq").alias("q_seq")), t.te.select(F.col("te_tid").cast("string").alias("t_id"), F.col("seq").alias("t_seq")), cfg.seed)
    te = t.te.select(F.col("te_tid").cast("string").alias("t_id"), F.col("te_tid").alias("own_tid"), F.col("name").alias("te_name"), F.col("length").alias("te_len"), F.col("class_bit").alias("cls"), "ltr_len")
    h = hits.join(te, "t_id").withColumnRenamed("q_id", "insertion_id").join(ins.select("insertion_id", F.length("ins_seq").alias("n"), "rep_tid"), "insertion_id")
    rev = F.col("strand") == 1
    bits = an.element_bits(F.col("t_start"), F.col("t_end"), F.col("te_len"), F.col("own_tid"), F.col("rep_tid"))
    row = F.struct(
        F.when(rev, F.col("n") - F.col("q_end")).otherwise(F.col("q_start")).cast("int").alias("start"), F.when(rev, F.col("n") - F.col("q_start")).otherwise(F.col("q_end")).cast("int").alias("end"),
        F.lit("TE").alias("kind"), rev.alias("reverse"), bits.alias("bits"), F.col("te_len").cast("int").alias("te_len"), F.col("cls").cast("bigint").alias("cls"), F.col("own_tid").cast("int").alias("te_tid"),
        F.col("t_start").alias("ref_start"), F.col("t_end").alias("ref_end"), F.col("score").alias("score"), F.col("te_name").alias("name"), F.col("ltr_len").cast("int").alias("ltr_len"),
    ).cast(ROW)
    ranked = F.transform(F.sort_array(F.collect_list(F.struct(F.col("score").alias("k"), (-F.col("own_tid")).alias("t"), row.alias("row"))), False), lambda x: x["row"])
    shared = lambda x, y: F.greatest(F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]), F.lit(0))
    # from the best on, an alignment stays unless half of it is explained already
    picked = F.aggregate("ranked", F.array().cast(f"array<{ROW}>"), lambda acc, x: F.when(F.exists(acc, lambda y: shared(x, y) * 2 > x["end"] - x["start"]), acc).otherwise(F.concat(acc, F.array(x))))
    found = h.groupBy("insertion_id").agg(ranked.alias("ranked")).select("insertion_id", F.array_sort(picked).alias("elements"))
    c = ins.join(found, "insertion_id").where(F.size("elements") > 0)
    tails = c.select("tid", "idx", "ins_seq", "upstream", "downstream", "elements").mapInPandas(_tails, "tid int, idx long, tails array<struct<start:int,end:int,kind:string>>, at_left boolean, at_right boolean")
    c = c.join(tails, KEYS)
    none = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(None).alias("reverse"), F.lit(0).alias("bits"), F.lit(None).alias("te_len"), F.lit(0).alias("cls"), F.lit(None).alias("te_tid"), F.lit(None).alias("ref_start"), F.lit(None).alias("ref_end"), F.lit(None).alias("score"), F.lit(None).alias("name"), F.lit(None).alias("ltr_len")).cast(ROW)  # noqa: E731, E501
    c = c.withColumn("rows", F.array_sort(F.concat("elements", F.transform("tails", none))))
    structure = an.structure_bits(F.col("rows"), F.length("ins_seq"), F.col("flag"), F.col("at_left"), F.col("at_right"))
    outer = an.outermost(F.col("elements"))
    first, last = outer["first"], outer["last"]
    cls = an.insertion_class(first, last)
    single = F.size("elements") == 1
    own = F.aggregate("elements", F.lit(0).cast("bigint"), lambda a, e: a.bitwiseOR(e["bits"])).bitwiseAND(F.lit(flags.BIT["SELF_TO_SELF"]).cast("bigint"))
    solo = F.coalesce(an.solo_ltr(cls == flags.BIT["LTR"], single, first["ref_start"], first["ref_end"], first["te_len"], first["ltr_len"]), F.lit(False))
    return c.withColumns({"a_start": first["start"], "a_end": last["end"], "flag": F.col("flag").bitwiseOR(structure).bitwiseOR(cls).bitwiseOR(own).bitwiseOR(flags.bits_if(TE_MAP=F.lit(True), SINGLE_TE=single, SOLO_LTR=solo))})


def with_tsd(c: DataFrame, t: Tables) -> DataFrame:
    """Reported start and end, and the duplicated target site, where both flanks are known; the insertion, its flanks and annotations follow where the flanks turn out to end."""
    both = flags.has(F.col("flag"), "SAME_FLANK_MAP", "DIFF_FLANK_MAP")
    before, behind = F.col("a_start"), F.length("ins_seq") - F.col("a_end")
    left_end, right_start = F.col("left_most") + before, F.col("right_most") - behind
    ok = both & (left_end <= F.length("left_asm")) & (right_start >= 0)
    c = c.withColumns({"q_left": F.when(ok, sq.sub(F.col("left_asm"), F.col("left_most") - 100, left_end)), "q_right": F.when(ok, sq.sub(F.col("right_asm"), right_start, F.col("right_most") + 100))})
    c = seqjoin.align_pairs(c, {"tl": ("q_left", "local"), "tr": ("q_right", "local")})
    lead, tail = _clip(F.col("tl.cigar"), False), _clip(F.col("tr.cigar"), True)
    call = an.tsd(F.col("ref_start"), F.col("ref_end"), F.when(lead <= 20, F.col("local_start") + F.col("tl.t_end")), F.when(tail <= 20, F.col("local_start") + F.col("tr.t_start")))
    c = c.withColumn("call", call).withColumns({"start": F.col("call.start"), "end": F.col("call.end")})
    # what isn't aligned of the queries is the insertion's: it begins and ends there, and positions on it move along
    into = F.when(F.col("call.code").isin(1, 3), _clip(F.col("tl.cigar"), True) - before).otherwise(F.lit(0))
    more = F.when(F.col("call.code").isin(2, 3), _clip(F.col("tr.cigar"), False) - behind).otherwise(F.lit(0))
    c = c.withColumns({"into": into.cast("int"), "more": more.cast("int")})
    c = c.withColumns({"left_most": F.col("left_most") - F.col("into"), "right_most": F.col("right_most") + F.col("more"), "rows": an.shifted(F.col("rows"), F.col("into"))})
    bounds = (F.col("flag"), F.col("left_asm"), F.col("right_asm"), F.col("left_most"), F.col("right_most"))
    beside, pad = an.flank_sequences(*bounds, FLANK), F.when(flags.has(F.col("flag"), "RIGHT_FLANK_MAP"), 50).otherwise(0)
    # an insertion that is open on the left is shown behind 50 N
    c = c.withColumns({"ins_seq": an.insertion_sequence(*bounds), "upstream": beside["upstream"], "downstream": beside["downstream"], "rows": an.shifted(F.col("rows"), pad)})
    return c.withColumn("flag", F.col("flag").bitwiseOR(flags.bits_if(TSD=F.col("call.tsd")))).drop("into", "more")


def genotyped(c: DataFrame, segs: DataFrame, t: Tables, cfg: CallerConfig) -> DataFrame:
    end = F.col("pos") + cg.sum_of(cg.ops(F.col("cigar")), cg.REF)
    reads = valid(t.alignments).select("aln_id", F.col("tid").alias("k"), F.col("pos").alias("i_start"), end.alias("i_end"))
    points = c.select(*KEYS, F.col("tid").alias("k"), F.col("start").alias("ref_start"), F.col("start").alias("ref_end"))
    ref = intervals.spanning(points, reads, segs.select(*KEYS, "aln_id").distinct(), "k", KEYS, "aln_id", cfg.span_margin, 4096)
    return c.join(ref, KEYS).withColumn("frequency", F.round(clusters.frequency(F.col("num_left"), F.col("num_middle"), F.col("num_right"), F.col("n_ref")), 6))


def report(c: DataFrame, t: Tables) -> DataFrame:
    """The result table, one row for each insertion with an element."""
    flag = F.col("flag").bitwiseOR(flags.post_filter(F.col("flag"), F.col("clt_type")))
    c = c.withColumn("flag", flag).select("*", *flags.decoded(flag)).join(t.contigs.select("tid", F.col("name").alias("chrom")), "tid")
    c = _reference(c, t, F.col("start"))
    family = merge.ordered_names(F.transform("elements", lambda e: F.struct(e["te_tid"].alias("order"), e["name"].alias("name"))))
    c = c.withColumns({"leftclip_reads": F.col("num_left"), "spanning_reads": F.col("num_middle"), "rightclip_reads": F.col("num_right")})
    return c.select(
        "chrom", "start", "end", family.alias("family"), "frequency", an.strand(F.col("elements")).alias("strand"), flags.genotype(F.col("frequency")).alias("genotype"),
        "passed", an.query_regions(F.col("rows")).alias("query_region"), an.target_regions(F.col("rows")).alias("target_region"), F.col("num_seg_raw").alias("total_support"),
        F.when(flags.has(F.col("flag"), "TSD"), sq.sub(F.col("ref_seq"), F.col("start") - F.col("ref_offset"), F.col("end") - F.col("ref_offset"))).otherwise(".").alias("tsd_seq"),
        sq.padded(F.col("ins_seq"), flags.has(F.col("flag"), "LEFT_FLANK_MAP"), flags.has(F.col("flag"), "RIGHT_FLANK_MAP")).alias("insertion_seq"), F.col("upstream").alias("upstream_seq"),
        F.col("downstream").alias("downstream_seq"), flags.extra_info().alias("extra_info"), "insertion_id", "flag", "probability",
    )


def ltr_lengths(te: DataFrame) -> DataFrame:
    """te_tid, ltr_len: how long the second half of an LTR element repeats the first from its start, 0 if it doesn't."""
    half = F.floor(F.length("seq") / 2).cast("int")
    t = te.where("te_class = 'LTR'").select("te_tid", F.substring("seq", F.lit(1), half).alias("left_half"), F.expr("substring(seq, cast(length(seq) / 2 as int) + 1)").alias("right_half"))
    a = seqjoin.align_pairs(t, {"a": ("right_half", "left_half")})
    return a.select("te_tid", ltr_length(F.col("a")).alias("ltr_len"))


def ltr_length(hit: Column) -> Column:
    """The length of a repeat from how an element's right half aligns to its left half: from the start on, and without a clip at the end; else 0."""
    ok = hit.isNotNull() & (hit["t_start"] <= 10) & (_clip(hit["cigar"], True) <= 10)
    return F.when(ok, hit["t_end"] - hit["t_start"]).otherwise(0)


def call(t: Tables, cfg: CallerConfig | None = None, high: Column | Scorer | None = None, low: Column | Scorer | None = None) -> DataFrame:
    """From alignments to the result table, with models for clusters of several reads and for the rest; each stage is written to the shared folder, so that plans stay small and a lost executor costs one stage."""
    cfg = cfg or CallerConfig()
    if t.tiles is None:
        t = replace(t, tiles=cut(tiles(t.refs, TILE, 4 * FLANK, "tid"), "tiles"))  # two stages read them
    built, segs = build(t, cfg, high, low)
    good = cut(built.where(~F.col("low_quality")), "clusters")
    found = cut(insertions(good, assemblies(good, segs, t, cfg), t), "insertions")
    named = cut(annotated(found, t, cfg), "annotations")
    placed = cut(with_tsd(named, t), "sites")
    return report(cut(genotyped(placed, segs, t, cfg), "genotypes"), t)


def summary(result: DataFrame, segs: DataFrame) -> DataFrame:
    return segs.agg(F.count(F.lit(1)).alias("segments")).crossJoin(result.agg(F.count(F.lit(1)).alias("insertions"), F.count_if("passed").alias("passed")))  # one row each
