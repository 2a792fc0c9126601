"""Queries over the operators of alignments, annotations and contigs, on rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import flags, scoring
from ..functions import sequences as sq
from ..operators import clusters as cl
from ..operators import intervals, merge, runs, seqjoin
from ..sources import text
from . import annotate as an
from . import caller
from . import catalogue as cat
from .registry import register, table

B = flags.BIT


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")).distinct()


_ITEMS = "li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem)"
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, q"
KEYS = _KEYS.split(", ")


def _bits(**conditions: str) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {c} THEN {B[n.lstrip('_')]} ELSE 0 END" for n, c in conditions.items()) + " AS BIGINT)"


# ---- alignments and segments


@register(f"WITH {_ITEMS}, a AS (SELECT *, (l_orderkey * 48271 + l_partkey) % 4096 AS flag FROM li) SELECT {_KEYS}, flag, flag & 3332 = 0 AS clean FROM a WHERE flag & 260 = 0")
def valid_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = caller.valid(_items(spark, sf_dir).withColumn("flag", F.expr("(l_orderkey * 48271 + l_partkey) % 4096")))
    return rows.select(*KEYS, "flag", caller.is_valid(F.col("flag"), caller.UNCLEAN).alias("clean"))


@register(f"""WITH {cat._WALK}, s AS (SELECT *, CASE i WHEN 0 THEN total WHEN 6 THEN wm ELSE least(wm, total - wm) END AS overhang FROM w WHERE op IN ('S', 'I') AND len >= 20)
SELECT {_KEYS}, CAST(overhang AS INTEGER) AS overhang FROM s WHERE overhang >= 40""")
def overhang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat._cigars(spark, sf_dir).select(*KEYS, F.explode(cg.segments(F.col("cigar"), F.lit(1000), 20, 40)).alias("s")).select(*KEYS, "s.overhang")


@register(f"""WITH {_ITEMS}, r AS (SELECT *, l_linenumber % 2 = 0 AS rev, q AS lead, l_orderkey % 45 + 1 AS tail, q + l_orderkey % 90 + 1 + l_partkey % 40 + l_suppkey % 30 + 1 + l_partkey % 25 + 1 + l_orderkey % 45 + 1 AS n FROM li)
SELECT {_KEYS}, CAST(CASE WHEN rev THEN tail ELSE lead END AS INTEGER) AS query_start, CAST(n - CASE WHEN rev THEN lead ELSE tail END AS INTEGER) AS query_end,
CAST(l_orderkey % 90 + 1 + l_partkey % 40 + l_suppkey % 30 + 1 + l_linenumber + l_partkey % 25 + 1 AS INTEGER) AS mapped,
round((l_suppkey % 50 - l_linenumber) / (l_orderkey % 90 + 1 + l_partkey % 40 + l_suppkey % 30 + 1 + l_linenumber + l_partkey % 25 + 1), 6) AS divergence FROM r""")
def query_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cat._cigars(spark, sf_dir)
    r = cg.query_range(F.col("cigar"), F.col("l_linenumber") % 2 == 0)
    d = cg.divergence(F.col("cigar"), F.col("l_suppkey") % 50, F.col("l_linenumber"))
    return c.select(*KEYS, r["start"].alias("query_start"), r["end"].alias("query_end"), cg.mapped_length(F.col("cigar")).alias("mapped"), F.round(d, 6).alias("divergence"))


@register(f"""WITH {cat._WALK}, b AS (SELECT {_KEYS}, op, i, wq, wr, unnest(range(0, len)) AS k FROM w WHERE op IN ('M', 'I', 'D') AND len > 0),
x AS (SELECT {_KEYS}, CASE WHEN op <> 'D' THEN wq + k END AS qp, CASE WHEN op <> 'I' THEN 1000 + wr + k END AS rp, row_number() OVER (PARTITION BY {_KEYS} ORDER BY i, k) - 1 AS n FROM b),
m AS (SELECT *, l_orderkey % 90 + 1 AS mid FROM x WHERE qp IS NOT NULL AND rp IS NOT NULL),
l AS (SELECT {_KEYS}, max(n) AS n FROM m WHERE n <= mid GROUP BY ALL), r AS (SELECT {_KEYS}, min(n) AS n FROM m WHERE n >= mid GROUP BY ALL), k AS (SELECT DISTINCT {_KEYS} FROM c)
SELECT {_KEYS}, CAST(CASE WHEN a.rp >= 1010 THEN a.qp END AS INTEGER) AS left_q, CAST(CASE WHEN z.rp <= 1080 THEN z.qp END AS INTEGER) AS right_q
FROM k LEFT JOIN (SELECT {_KEYS}, x.qp, x.rp FROM l JOIN x USING ({_KEYS}, n)) a USING ({_KEYS}) LEFT JOIN (SELECT {_KEYS}, x.qp, x.rp FROM r JOIN x USING ({_KEYS}, n)) z USING ({_KEYS})""")
def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = (F.col("l_orderkey") % 90 + 1).cast("int")
    c = cat._cigars(spark, sf_dir).select(*KEYS, mid.alias("mid"), cg.aligned_pairs(F.col("cigar"), F.lit(1000)).alias("p"))
    near = lambda bound, left: cg.nearest_pair(F.col("p"), F.col("mid"), F.lit(bound), left)["q"]
    return c.select(*KEYS, near(1010, True).alias("left_q"), near(1080, False).alias("right_q"))


@register("""WITH t AS (SELECT DISTINCT CAST(1 << (l_orderkey % 3) AS INTEGER) AS a, CAST(1 << (l_partkey % 3) AS INTEGER) AS b FROM lineitem)
SELECT a, b, CASE a | b WHEN 1 THEN 1 WHEN 5 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 6 THEN 16 ELSE 0 END AS location FROM t""")
def alignment_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.expr("shiftleft(1, cast(l_orderkey % 3 as int))").alias("a"), F.expr("shiftleft(1, cast(l_partkey % 3 as int))").alias("b")).distinct()
    return t.select("a", "b", intervals.alignment_location(F.col("a"), F.col("b")).alias("location"))


_SEGS = """s AS (SELECT DISTINCT l_suppkey, l_orderkey, l_orderkey * 1000003 + l_partkey * 7 + l_linenumber AS seg_id, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS pos, 1 << (l_linenumber % 3) AS seg_type, l_partkey % 3 AS te,
  CAST(l_quantity AS INTEGER) % 10 AS mq, l_orderkey % 8 AS aln_type, 1 << CAST(l_orderkey % 5 AS INTEGER) AS loc, l_extendedprice AS score, CAST(l_quantity AS INTEGER) AS maplen, 100 + l_partkey % 50 AS qe, l_discount AS div, 500 + l_partkey % 300 AS rl FROM lineitem)"""


@register(f"""WITH {_SEGS}, m AS (SELECT l_suppkey, pos FROM s GROUP BY l_suppkey, pos QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, pos) = 1),
p AS (SELECT l_suppkey, seg_id FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(seg_type = 2 AS INTEGER) DESC, CASE WHEN seg_type = 2 THEN rl ELSE qe END DESC, seg_id) = 1),
f AS (SELECT l_suppkey, count(*) AS n, min(pos) - 1 AS ref_start, max(pos) AS ref_end, count(*) FILTER (te > 0) / count(*) AS te_aligned_frac, avg(mq) AS mean_map_qual, count(*) FILTER (mq < 5) / count(*) AS low_map_qual_frac,
  count(*) FILTER (aln_type & 5 = 5) / count(*) AS dual_clip_frac, count(*) FILTER (loc = 16) / count(*) AS aln_frac_16, coalesce(sum(score / te) FILTER (te > 0), 0) / count(*) AS mean_aln_score,
  coalesce(sum(maplen / qe) FILTER (te > 0), 0) / count(*) AS mean_query_map_frac, sum(CASE WHEN te > 0 THEN div / te ELSE 0.05 END) / count(*) / 0.05 AS mean_divergence, count(DISTINCT l_orderkey) AS reads FROM s GROUP BY l_suppkey)
SELECT l_suppkey, n AS num_seg_raw, ref_start, ref_end, round(te_aligned_frac, 6) AS te_aligned_frac, round(mean_map_qual, 6) AS mean_map_qual, round(low_map_qual_frac, 6) AS low_map_qual_frac, round(dual_clip_frac, 6) AS dual_clip_frac,
round(aln_frac_16, 6) AS aln_frac_16, round(mean_aln_score, 4) AS mean_aln_score, round(mean_query_map_frac, 6) AS mean_query_map_frac, round(mean_divergence, 6) AS mean_divergence, round(n / 3.0, 6) AS num_seg,
CASE WHEN n = 1 THEN 1 WHEN n = 2 AND reads = 1 THEN 2 ELSE 0 END AS clt_type, m.pos AS ref_mode, seg_id AS rep_seg_id FROM f JOIN m USING (l_suppkey) JOIN p USING (l_suppkey)""")
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    whole = F.col("l_quantity").cast("int")
    s = li.select(
        "l_suppkey", F.col("l_orderkey").alias("qname"), F.expr("l_orderkey * 1000003 + l_partkey * 7 + l_linenumber").alias("seg_id"), cat._days("l_shipdate").alias("ref_position"), F.expr("shiftleft(1, l_linenumber % 3)").alias("seg_type"),
        (F.col("l_partkey") % 3).alias("num_te_aln"), (whole % 10).alias("map_qual"), (F.col("l_orderkey") % 8).alias("aln_type"), F.expr("shiftleft(1, cast(l_orderkey % 5 as int))").alias("aln_location_type"),
        F.col("l_extendedprice").alias("sum_aln_score"), whole.alias("sum_query_maplen"), F.lit(0).alias("query_start"), (F.col("l_partkey") % 50 + 100).alias("query_end"), F.col("l_discount").alias("sum_divergence"), (F.col("l_partkey") % 300 + 500).alias("read_len"),
    ).distinct()
    f = cl.features(s, ["l_suppkey"], 0.05, 3.0, 100.0)
    rounded = ("te_aligned_frac", "mean_map_qual", "low_map_qual_frac", "dual_clip_frac", "aln_frac_16", "mean_query_map_frac", "mean_divergence", "num_seg")
    return f.select("l_suppkey", "num_seg_raw", "ref_start", "ref_end", *(cat._r(F.col(c), c) for c in rounded), cat._r(F.col("mean_aln_score"), "mean_aln_score", 4), "clt_type", "ref_mode", "rep_seg_id")


_TYPED = f"{cat.EV}, {cat.GC}, {cat.FEAT}, ty AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN n = 2 AND n_types = 1 THEN 2 ELSE 0 END AS clt_type, user_id % 7 = 0 AS black FROM fx)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cat.featured(spark, sf_dir)
    return f.withColumn("clt_type", cl.cluster_type(F.col("n"), F.col("n_types"))).withColumn("black", F.col("user_id") % 7 == 0)


@register(f"""WITH {_TYPED} SELECT user_id, idx, round(CASE WHEN te_frac >= 0.8 AND NOT black THEN CASE WHEN clt_type = 0 THEN {cat.PROB} ELSE 1 / (1 + exp(-(-0.5::DOUBLE + mean_value * 0.01::DOUBLE))) END ELSE 0 END, 6) AS probability FROM ty""")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.gated(_typed(spark, sf_dir), scoring.logistic(cat.WEIGHTS, cat.BIAS), scoring.logistic({"mean_value": 0.01}, -0.5), "clt_type", "te_frac", "black")
    return out.select("user_id", "idx", cat._r(F.col("probability"), "probability"))


@register(f"WITH {_TYPED} SELECT user_id, idx, n FROM ty WHERE clt_type <> 0")
def low_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).where(cl.is_low_frequency(F.col("clt_type"))).select("user_id", "idx", "n")


# ---- bounds and structure of insertions

_BOUNDS = """b AS (SELECT *, CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey % 2 END AS tid1, CASE WHEN l_partkey % 6 <> 0 THEN l_partkey % 2 END AS tid2, l_partkey % 1000 AS left_most, l_suppkey * 7 % 1200 AS right_most, q * 10 AS clip1, l_linenumber * 70 AS clip2 FROM li)"""


@register(f"""WITH {_ITEMS}, {_BOUNDS} SELECT {_KEYS}, CAST(CASE WHEN tid1 IS NULL AND tid2 IS NULL THEN 0 WHEN clip1 > 400 AND clip2 > 400 THEN 0 WHEN tid2 IS NULL THEN 4 WHEN tid1 IS NULL THEN 8 WHEN clip2 > 400 THEN 4 WHEN clip1 > 400 THEN 8
WHEN tid1 = tid2 AND left_most <= right_most - 100 THEN 32 WHEN tid1 <> tid2 THEN 16 ELSE 0 END AS BIGINT) AS flag FROM b""")
def region_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tid = lambda c, k: F.when(F.col(c) % k != 0, F.col(c) % 2)
    flag = an.region_bits(tid("l_orderkey", 5), tid("l_partkey", 6), F.col("l_partkey") % 1000, F.col("l_suppkey") * 7 % 1200, F.col("q") * 10, F.col("l_linenumber") * 70)
    return _items(spark, sf_dir).select(*KEYS, flag.alias("flag"))


@register(f"""WITH {_ITEMS}, e AS (SELECT *, l_partkey % 300 AS s, 200 + l_suppkey % 1000 AS n, 200 + l_suppkey % 1000 - l_orderkey % 300 AS e FROM li)
SELECT {_KEYS}, {_bits(_5P_FULL="s < floor(least(n * 0.08, 100.0))", _3P_FULL="n - e < floor(least(n * 0.08, 100.0))", SELF_TO_SELF="l_linenumber = l_orderkey % 7")} AS bits FROM e""")
def element_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_suppkey") % 1000 + 200
    return _items(spark, sf_dir).select(*KEYS, an.element_bits(F.col("l_partkey") % 300, n - F.col("l_orderkey") % 300, n, F.col("l_linenumber").cast("long"), F.col("l_orderkey") % 7).alias("bits"))


@register(f"""WITH {_ITEMS}, e AS (SELECT *, 900 AS n, 90 + l_suppkey % 40 AS ltr, l_partkey % 900 AS s, 70 + l_orderkey % 900 AS e FROM li)
SELECT {_KEYS}, l_linenumber % 2 = 0 AND q % 3 <> 0 AND ltr > 0 AND ((s <= 20 AND abs(e - ltr) <= 20) OR (abs(s - (n - ltr)) <= 20 AND abs(e - n) <= 20)) AS solo FROM e""")
def solo_ltr(spark: SparkSession, sf_dir: str) -> DataFrame:
    solo = an.solo_ltr(F.col("l_linenumber") % 2 == 0, F.col("q") % 3 != 0, F.col("l_partkey") % 900, F.col("l_orderkey") % 900 + 70, F.lit(900), F.col("l_suppkey") % 40 + 90)
    return _items(spark, sf_dir).select(*KEYS, solo.alias("solo"))


@register(f"""WITH {_ITEMS} SELECT {_KEYS}, CASE WHEN l_partkey % 20 <= 10 AND q % 13 <= 10 AND l_linenumber <> 3 THEN CAST(l_orderkey % 500 - l_partkey % 20 AS INTEGER) ELSE 0 END AS ltr_len FROM li""")
def ltr_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = (F.col("q") % 13).cast("string")
    hit = F.when(F.col("l_linenumber") != 3, F.struct((F.col("l_partkey") % 20).cast("int").alias("t_start"), (F.col("l_orderkey") % 500).cast("int").alias("t_end"), F.concat(F.lit("50M"), tail, F.lit("S")).alias("cigar")))
    return _items(spark, sf_dir).withColumn("hit", hit).select(*KEYS, caller.ltr_length(F.col("hit")).alias("ltr_len"))


#: Annotation rows, some of them tails, of each order.
_ROWS = f"""r AS (SELECT DISTINCT l_orderkey AS k, CAST(l_partkey % 500 - CASE WHEN l_linenumber % 4 = 3 THEN 100 ELSE 0 END AS INTEGER) AS s, CAST(l_partkey % 500 + 20 + l_suppkey % 80 AS INTEGER) AS e, CASE l_linenumber % 4 WHEN 0 THEN 'PolyA' WHEN 3 THEN 'PolyT' ELSE 'TE' END AS kind,
  l_partkey, l_suppkey FROM lineitem),
a AS (SELECT k, s, e, kind, CASE WHEN kind = 'TE' THEN l_suppkey % 2 = 0 END AS reverse, CASE WHEN kind = 'TE' THEN CASE WHEN l_suppkey % 3 = 0 THEN {B['5P_FULL']} ELSE 0 END + CASE WHEN l_suppkey % 4 <> 0 THEN {B['3P_FULL']} ELSE 0 END ELSE 0 END AS bits,
  CASE WHEN kind = 'TE' THEN CAST(300 + l_partkey % 700 AS INTEGER) END AS te_len, CASE WHEN kind = 'TE' THEN 1 << CAST(15 + l_partkey % 5 AS INTEGER) ELSE 0 END AS cls, CASE WHEN kind = 'TE' THEN CAST(l_partkey % 7 AS INTEGER) END AS tid,
  CASE WHEN kind = 'TE' THEN CAST(l_suppkey % 60 AS INTEGER) END AS rs, CASE WHEN kind = 'TE' THEN CAST(80 + l_partkey % 220 AS INTEGER) END AS re FROM r),
l AS (SELECT k, list({{'s': s, 'e': e, 'kind': kind, 'reverse': reverse, 'bits': bits, 'te_len': te_len, 'cls': cls, 'tid': tid, 'rs': rs, 're': re}} ORDER BY s, e, kind, reverse, bits, te_len, cls, tid, rs, re) AS rows FROM a GROUP BY k)"""


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and rows: annotations in order; items of one part, supplier and kind are one, others stay, also where their annotations are equal."""
    line = F.col("l_linenumber") % 4
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.when(line == 0, 0).when(line == 3, 3).otherwise(1).alias("m")).distinct()
    te = F.col("m") == 1
    only = lambda c: F.when(te, c)
    bits = F.when(F.col("l_suppkey") % 3 == 0, B["5P_FULL"]).otherwise(0) + F.when(F.col("l_suppkey") % 4 != 0, B["3P_FULL"]).otherwise(0)
    tid = (F.col("l_partkey") % 7).cast("int")
    row = F.struct(
        (F.col("l_partkey") % 500 - F.when(F.col("m") == 3, 100).otherwise(0)).cast("int").alias("start"), (F.col("l_partkey") % 500 + 20 + F.col("l_suppkey") % 80).cast("int").alias("end"),
        F.when(F.col("m") == 0, "PolyA").when(F.col("m") == 3, "PolyT").otherwise("TE").alias("kind"), only(F.col("l_suppkey") % 2 == 0).alias("reverse"), F.when(te, bits).otherwise(0).cast("long").alias("bits"),
        only((F.col("l_partkey") % 700 + 300).cast("int")).alias("te_len"), F.when(te, F.expr("shiftleft(cast(1 as bigint), cast(15 + l_partkey % 5 as int))")).otherwise(F.lit(0).cast("long")).alias("cls"), only(tid).alias("te_tid"),
        only((F.col("l_suppkey") % 60).cast("int")).alias("ref_start"), only((F.col("l_partkey") % 220 + 80).cast("int")).alias("ref_end"), only(F.concat(F.lit("T"), tid.cast("string"))).alias("name"),
    )
    return li.select(F.col("l_orderkey").alias("k"), row.alias("row")).groupBy("k").agg(F.array_sort(F.collect_list("row")).alias("rows"))


_STRUCTURE = f"""x AS (SELECT k, rows, len(rows) AS n, rows[1] AS f, rows[len(rows)] AS t, list_filter(rows, lambda r: r.kind <> 'PolyT')[1] AS lf, list_filter(rows, lambda r: r.kind <> 'PolyA')[-1] AS rg, rows[nullif(list_position(list_transform(rows, lambda r: r.kind <> 'PolyT'), true), 0) - 1] AS bf, rows[len(rows) - nullif(list_position(list_reverse(list_transform(rows, lambda r: r.kind <> 'PolyA')), true), 0) + 2] AS af,
  k * 48271 % 64 & 4 <> 0 AS lo, k * 48271 % 64 & 8 <> 0 AS ro, k % 3 = 0 AS at_l, k % 4 = 0 AS at_r FROM l),
y AS (SELECT *, coalesce(lf.reverse, false) AS rev_l, coalesce(rg.reverse, false) AS rev_r, coalesce(lf.kind = 'TE', false) AND NOT coalesce(lf.reverse, false) AS fwd_l, coalesce(rg.kind = 'TE', false) AND NOT coalesce(rg.reverse, false) AS fwd_r,
  coalesce(lf.bits & {B['5P_FULL']} <> 0, false) AS five_l, coalesce(rg.bits & {B['5P_FULL']} <> 0, false) AS five_r, coalesce(lf.bits & {B['3P_FULL']} <> 0, false) AS three_l, coalesce(rg.bits & {B['3P_FULL']} <> 0, false) AS three_r,
  coalesce(lf.cls & {flags.mask(*flags.RETRO)} <> 0, false) AS retro_l, coalesce(rg.cls & {flags.mask(*flags.RETRO)} <> 0, false) AS retro_r FROM x),
z AS (SELECT *, n >= 2 AND (coalesce(f.kind = 'PolyT' AND three_l AND lf.s - bf.e < 20 AND f.s < 100, false) OR coalesce(t.kind = 'PolyA' AND three_r AND af.s - rg.e < 20 AND 600 - t.e < 100, false)) AS poly,
  (fwd_l AND five_l) OR (rev_r AND five_r) AS full5, (rev_l AND three_l) OR (fwd_r AND three_r) AS full3 FROM y)"""


@register(f"""WITH {_ROWS}, {_STRUCTURE} SELECT k, {_bits(LEFT_NEAR_END="f.s < greatest(coalesce(lf.te_len * 0.2, 0), 100.0)", RIGHT_NEAR_END="600 - t.e < greatest(coalesce(rg.te_len * 0.2, 0), 100.0)", POLYA="poly", _5P_FULL="full5", _3P_FULL="full3",
    _5P_UNKNOWN="NOT full5 AND ((fwd_l AND ro) OR (rev_r AND lo))", _3P_UNKNOWN="NOT full3 AND ((rev_l AND ro) OR (fwd_r AND lo))", AT_RICH="NOT poly AND ((at_l AND rev_l AND three_l AND retro_l) OR (at_r AND fwd_r AND three_r AND retro_r))")} AS bits FROM z""")
def structure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = an.structure_bits(F.col("rows"), F.lit(600), F.col("k") * 48271 % 64, F.col("k") % 3 == 0, F.col("k") % 4 == 0)
    return _annotations(spark, sf_dir).select("k", bits.alias("bits"))


@register(f"""WITH {_ROWS}, e AS (SELECT k, list_filter(rows, lambda r: r.kind = 'TE') AS el FROM l), o AS (SELECT k, el, el[1] AS f, list_max(list_transform(el, lambda r: r.e)) AS last_e FROM e WHERE len(el) > 0),
p AS (SELECT *, list_filter(el, lambda r: r.e = last_e)[1] AS t FROM o)
SELECT k, f.s AS first_start, t.s AS last_start, t.e AS last_end, CAST(CASE WHEN f.re - f.rs > t.re - t.rs THEN f.cls ELSE t.cls END AS BIGINT) AS cls, CASE sign(list_sum(list_transform(el, lambda r: CASE WHEN r.reverse THEN -1 ELSE 1 END))) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END AS strand FROM p""")
def outer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _annotations(spark, sf_dir).select("k", F.filter("rows", lambda r: r["kind"] == "TE").alias("el")).where(F.size("el") > 0).withColumn("o", an.outermost(F.col("el")))
    first, last = F.col("o.first"), F.col("o.last")
    return e.select("k", first["start"].alias("first_start"), last["start"].alias("last_start"), last["end"].alias("last_end"), an.insertion_class(first, last).alias("cls"), an.strand(F.col("el")).alias("strand"))


@register(f"""WITH {_ROWS}, m AS (SELECT k, list_transform(rows, lambda r: {{'r': r, 's': r.s + CAST(k % 30 AS INTEGER), 'e': r.e + CAST(k % 30 AS INTEGER)}}) AS rows FROM l)
SELECT k, array_to_string(list_transform(rows, lambda x: concat(CASE WHEN coalesce(x.r.reverse, x.r.kind = 'PolyT') THEN '-' ELSE '+' END, ':', CASE WHEN x.r.kind = 'PolyT' AND x.s < 0 THEN concat('(', -x.s, ')0') ELSE CAST(x.s AS VARCHAR) END, '-', x.e)), ',') AS query_region,
array_to_string(list_transform(rows, lambda x: CASE WHEN x.r.kind = 'TE' THEN concat('T', x.r.tid, ':', x.r.rs, '-', x.r.re) ELSE x.r.kind END), ',') AS target_region,
array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(rows, lambda x: x.r.kind = 'TE'), lambda x: x.r.tid))), lambda i: concat('T', i)), ',') AS families FROM m""")
def region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = an.shifted(F.col("rows"), (F.col("k") % 30).cast("int"))
    names = merge.ordered_names(F.transform(F.filter("rows", lambda r: r["kind"] == "TE"), lambda r: F.struct(r["te_tid"].alias("order"), r["name"].alias("name"))))
    return _annotations(spark, sf_dir).select("k", rows.alias("rows")).select("k", an.query_regions(F.col("rows")).alias("query_region"), an.target_regions(F.col("rows")).alias("target_region"), names.alias("families"))


@register("""WITH c AS (SELECT l_orderkey AS k, l_suppkey % 40 AS clip, l_partkey AS place, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS o FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_linenumber FROM lineitem))
SELECT k, clip, place FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY clip, o DESC) = 1""")
def flank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_partkey").alias("place"), F.col("l_suppkey").alias("s"), "l_linenumber", (F.col("l_suppkey") % 40).alias("clip")).alias("hit")).distinct()
    hits = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    return hits.withColumn("best", an.flank_hit(F.col("hits"))).select("k", "best.clip", "best.place")


# ---- contigs (whole texts)

_CONTIG = """t AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(reverse(text), '') AS b, CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 32 ELSE 16 END AS flag, length(coalesce(text, '')) AS n FROM documents),
u AS (SELECT *, CASE WHEN flag = 16 THEN b ELSE a END AS z, n // 4 AS lm, n // 4 * 3 AS rm FROM t)"""


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), F.reverse(a).alias("b"), F.expr("cast(case doc_id % 4 when 0 then 4 when 1 then 8 when 2 then 32 else 16 end as bigint)").alias("flag"), F.length(a).alias("n"))
    return d.withColumns({"z": F.when(F.col("flag") == 16, F.col("b")).otherwise(F.col("a")), "lm": F.expr("cast(n div 4 as int)"), "rm": F.expr("cast(n div 4 * 3 as int)")})


@register(f"""WITH {_CONTIG} SELECT doc_id, md5(CASE flag WHEN 4 THEN substr(a, lm + 1) WHEN 8 THEN substr(z, 1, rm) WHEN 32 THEN substr(a, lm + 1, rm - lm) ELSE concat(substr(a, lm + 1), repeat('N', 500), substr(z, 1, rm)) END) AS insertion,
CASE WHEN flag = 8 THEN '.' ELSE md5(substr(a, greatest(lm - 500, 0) + 1, lm - greatest(lm - 500, 0))) END AS upstream, CASE WHEN flag = 4 THEN '.' ELSE md5(substr(z, rm + 1, least(rm + 500, n) - rm)) END AS downstream FROM u""")
def insertion_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contigs(spark, sf_dir)
    args = (F.col("flag"), F.col("a"), F.col("z"), F.col("lm"), F.col("rm"))
    f = an.flank_sequences(*args)
    own = lambda x, bit: F.when(F.col("flag") == bit, ".").otherwise(F.md5(x))  # noqa: E731  a text of '.' alone is hashed
    return c.select("doc_id", F.md5(an.insertion_sequence(*args)).alias("insertion"), own(f["upstream"], 8).alias("upstream"), own(f["downstream"], 4).alias("downstream"))


@register(f"""WITH {_CONTIG}, v AS (SELECT *, CASE WHEN flag IN (4, 8) AND CASE WHEN flag = 4 THEN n - lm ELSE rm END >= 250 THEN true END AS ok FROM u)
SELECT doc_id, CASE WHEN ok THEN md5(CASE WHEN flag = 4 THEN substr(a, greatest(lm - 200, 0) + 1, lm - greatest(lm - 200, 0)) ELSE substr(a, 1, least(200, n)) END) END AS left_end,
CASE WHEN ok THEN md5(CASE WHEN flag = 4 THEN substr(a, greatest(n - 200, 0) + 1) ELSE substr(a, rm + 1, least(rm + 200, n) - rm) END) END AS right_end FROM v""")
def contig_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = an.contig_ends(F.col("flag"), F.col("a"), F.col("lm"), F.col("rm"))
    return _contigs(spark, sf_dir).select("doc_id", e.alias("e")).select("doc_id", F.md5("e.left").alias("left_end"), F.md5("e.right").alias("right_end"))


_RESET = """f AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 32 END AS flag, 400 + l_partkey % 90 AS le, 400 + l_suppkey % 90 AS rs, l_orderkey % 60 AS c1, q AS c2, 1000 AS ls, 1440 AS s, 1450 AS e, 3000 AS n, 700 AS lm, 900 AS rm FROM li),
o AS (SELECT *, flag IN (4, 8) AND c1 <= 50 AND c2 <= 50 AND least(abs(le + ls - s), abs(le + ls - e)) <= 50 AND least(abs(rs + ls - s), abs(rs + ls - e)) <= 50 AND abs(rs - le) <= 50 AND l_orderkey % 11 <> 0 AS ok FROM f)"""


@register(f"""WITH {_ITEMS}, {_RESET} SELECT {_KEYS}, CAST(CASE WHEN ok THEN 32 ELSE flag END AS BIGINT) AS flag, CAST(CASE WHEN ok AND flag = 8 THEN 200 - l_suppkey % 30 ELSE lm END AS INTEGER) AS left_most, CAST(CASE WHEN ok AND flag = 4 THEN n - (200 - l_partkey % 40) ELSE rm END AS INTEGER) AS right_most FROM o""")
def one_flank_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda c: c.cast("int")
    there = F.col("l_orderkey") % 11 != 0
    left = F.when(there, F.struct(i(F.col("l_partkey") % 90 + 400).alias("end"), i(F.col("l_orderkey") % 60).alias("clip_out"), i(F.col("l_suppkey") % 30).alias("last"), F.lit(200).alias("size")))
    right = F.struct(i(F.col("l_suppkey") % 90 + 400).alias("start"), F.col("q").alias("clip_out"), i(F.col("l_partkey") % 40).alias("first"), F.lit(200).alias("size"))
    flag = F.when(F.col("l_linenumber") % 3 == 0, 4).when(F.col("l_linenumber") % 3 == 1, 8).otherwise(32).cast("long")
    out = an.reset_one_flank(flag, left, right, F.lit(1000), F.lit(1440), F.lit(1450), F.lit(3000), F.lit(700), F.lit(900))
    return _items(spark, sf_dir).select(*KEYS, out.alias("o")).select(*KEYS, "o.*")


@register("""WITH t AS (SELECT doc_id, text, length(text) // 2 AS m FROM documents WHERE length(text) >= 2)
SELECT doc_id, CASE WHEN upper(text[m]) = upper(text[m + 1]) THEN 1 ELSE 0 END AS extra FROM t""")
def extra_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("length(text) >= 2").selectExpr("doc_id", "text", "cast(length(text) div 2 as int) m")
    at = lambda i: F.substring(F.col("text"), i, F.lit(1))
    return t.select("doc_id", sq.extra_length(at(F.col("m")), at(F.col("m") + 1)).alias("extra"))


@register("""WITH t AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS "offset" FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS name, CAST("offset" // 1000 AS INTEGER) AS tile, CAST("offset" AS INTEGER) AS "offset", md5(substr(text, "offset" + 1, 1100)) AS seq FROM t""")
def reference_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("name"), F.col("text").alias("seq"))
    return text.tiles(d, 1000, 100).select("name", "tile", "offset", F.md5("seq").alias("seq"))


@register("""SELECT p_partkey, p_name AS name, CAST(CASE p_brand[-1] WHEN '1' THEN 32768 WHEN '2' THEN 65536 WHEN '3' THEN 131072 WHEN '4' THEN 262144 WHEN '5' THEN 524288 ELSE 0 END AS BIGINT) AS class_bit, CAST(length(p_name) AS INTEGER) AS length FROM part""")
def element_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*(F.lit(c) for c in flags.CLASSES)), F.coalesce(F.when(F.substring("p_brand", -1, 1).isin("1", "2", "3", "4", "5"), F.substring("p_brand", -1, 1).cast("int")), F.lit(1)))
    cls = F.when(F.substring("p_brand", -1, 1).isin("1", "2", "3", "4", "5"), names)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"), F.length("p_name").alias("length"), cls.alias("te_class"))
    return text.fasta_index(p.withColumn("class_bit", flags.class_bit(F.col("te_class"))), "class_bit").select(F.col("ordinal").alias("p_partkey"), "name", "class_bit", "length")


@register("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by ranges and sorted within; the comparison here doesn't look at the order, a test does."""
    return merge.sorted_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


# ---- sequence join

#: Letters of texts as bases, so that texts are sequences.
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ,.", "ACGTACGTACGTACGTACGTACGTACNNN"
_SEQS = f"""q AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_replace(translate(lower(text), '{_LETTERS}', '{_BASES}'), '[^ACGTN]', 'N', 'g') AS s FROM benchmark),
o AS (SELECT id, 0 AS strand, s FROM q UNION ALL SELECT id, 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM q),
k AS (SELECT id, strand, p, substr(s, p + 1, 11) AS w FROM (SELECT *, unnest(range(0, length(s) - 10)) AS p FROM o WHERE length(s) >= 11)),
h AS (SELECT a.id AS q_id, b.id AS t_id, a.strand, a.p AS q_pos, b.p AS t_pos FROM k a JOIN k b ON a.w = b.w AND b.strand = 0 WHERE NOT contains(a.w, 'N'))"""


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = F.regexp_replace(F.translate(F.lower("text"), _LETTERS, _BASES), "[^ACGTN]", "N")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("q_id"), s.alias("q_seq"))
    return q, q.toDF("t_id", "t_seq")


@register(f"WITH {_SEQS} SELECT q_id, t_id, strand, count(*) AS n, CAST(sum(q_pos) AS BIGINT) AS q_sum, CAST(sum(t_pos) AS BIGINT) AS t_sum FROM h GROUP BY q_id, t_id, strand")
def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seqjoin.seeds(*_sequences(spark, sf_dir))
    return s.groupBy("q_id", "t_id", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("q_pos").alias("q_sum"), F.sum("t_pos").alias("t_sum"))


@register(f"""WITH {_SEQS} SELECT q_id, t_id, strand, CAST(floor((q_pos - t_pos) / 64) AS BIGINT) AS diag, count(*) AS n_seeds, CAST(min(q_pos) AS INTEGER) AS q_lo, CAST(max(q_pos) AS INTEGER) AS q_hi, CAST(min(t_pos) AS INTEGER) AS t_lo, CAST(max(t_pos) AS INTEGER) AS t_hi
FROM h GROUP BY q_id, t_id, strand, floor((q_pos - t_pos) / 64)""")
def seed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqjoin.chained(*_sequences(spark, sf_dir))


@register(None)
def flank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text begins with a run of A, or ends with one of T, near its end; an ordered fold, held against a plain one in tests."""
    seq = F.translate(F.lower("text"), "aeiouthnrsd ,.", "AAAAAAAAAAATTT")
    return runs.with_flank_runs(table(spark, sf_dir, "documents").select("doc_id", seq.alias("seq")), "seq", 20).select("doc_id", "at_start", "at_end")
