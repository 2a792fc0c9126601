import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.functions import cigar as cg
from strandflow.functions import flags, scoring, sequences
from strandflow.operators import assembly, clusters, consensus, cover, intervals, runs, seqjoin
from strandflow.plans import annotate


def test_gap_clusters_with_and_without_bins(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(0, 4000), i) for i, k in enumerate(rng.choice("aab") for _ in range(600))]
    rows += [("edge", 100, 9001), ("edge", 150, 9002), ("edge", 201, 9003)]  # gaps of exactly 50, and of 51
    df = spark.createDataFrame(rows, "k string, p long, i long")
    want, last = {}, {}
    for k, p, i in sorted(rows):
        n, before = last.get(k, (-1, None))
        n += before is None or p - before > 50
        last[k] = (n, p)
        want[i] = n
    for width in (None, 64, 1000):
        got = {r.i: r.idx for r in clusters.gap_cluster(df, ["k"], "p", 50, ["i"], bin_width=width).collect()}
        assert got == want


def test_pair_totals_beside_cigars_without_pairs(spark):
    cigars = ["3M", "5S", None, "", "2M1D2M1I", "10H", None]
    rows = spark.createDataFrame(list(enumerate(cigars)), "i int, cigar string").coalesce(1)
    got = {r.i: r.t for r in rows.select("i", cg.pair_totals(F.col("cigar"), F.lit(10)).alias("t")).collect()}
    assert tuple(got[0]) == (3, 0, 0, 0 + 1 + 2, 10 + 11 + 12, 0 * 10 + 1 * 11 + 2 * 12)
    assert tuple(got[4]) == (6, 1, 1, 0 + 1 + 2 + 3 + 4, 10 + 11 + 12 + 13 + 14, 11 + 2 * 13 + 3 * 14)
    assert all(tuple(got[i]) == (0, 0, 0, None, None, None) for i in (1, 2, 3, 5, 6))


def test_running_cover_is_the_fold(spark):
    rng = random.Random(2)
    rows = [(g, s, s + rng.randrange(1, 60), i) for i, (g, s) in enumerate((rng.randrange(9), rng.randrange(300)) for _ in range(300))]
    df = spark.createDataFrame(rows, "g int, s int, e int, i int")
    got, binned = ({r.i: (r.counted, r.added) for r in cover.running_cover(df, ["g"], "s", "e", ["e", "i"], width).collect()} for width in (None, 40))
    assert got == binned
    top = {}
    for g, s, e, i in sorted(rows):
        prev = top.get(g)
        new = prev is None or e > prev
        assert got[i] == (new, e - max(s, prev if prev is not None else s) if new else 0)
        top[g] = e if prev is None else max(prev, e)


def test_interval_joins_are_complete(spark):
    rng = random.Random(3)
    q = [(rng.choice("xy"), s, s + rng.randrange(0, 90), i) for i, s in enumerate(rng.randrange(3000) for _ in range(150))]
    iv = [(rng.choice("xy"), s, s + rng.randrange(1, 400), i) for i, s in enumerate(rng.randrange(3000) for _ in range(120))]
    a, b = spark.createDataFrame(q, "k string, start long, end long, id long"), spark.createDataFrame(iv, "k string, i_start long, i_end long, rep long")
    got = sorted((r.id, r.rep) for r in intervals.overlap_pairs(a, b, "k", 50, 128).collect())
    assert got == sorted((i, j) for k, s, e, i in q for m, u, v, j in iv if k == m and u < e + 50 and v > max(s - 50, 0))
    out = {r.id: r for r in intervals.interval_overlaps(a, b, "k", ["id"], 50, 128, "rep").collect()}
    for k, s, e, i in q:
        hits = [(u, v, j) for m, u, v, j in iv if k == m and u < e + 50 and v > max(s - 50, 0)]
        assert out[i].n == len(hits)
        if hits:
            assert out[i].rep == max(hits, key=lambda h: (h[0], h[1], -h[2]))[2]
            assert out[i].min_dist == min(abs(x - y) for u, v, _ in hits for x in (s, e) for y in (u, v))
    semi = {r.id for r in intervals.semi(a, b, "k", ["id"], 2, 128).collect()}
    anti = {r.id for r in intervals.semi(a, b, "k", ["id"], 2, 128, "left_anti").collect()}
    assert semi | anti == {r[3] for r in q} and not semi & anti


def _walk(cigar, pos, least):
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    total, q, r, m, out = sum(n for n, o in ops if o in "M=X"), 0, pos, 0, []
    for i, (n, o) in enumerate(ops):
        if o in "SI" and n >= least:
            kind = 1 if i == 0 else 4 if i == len(ops) - 1 else 2
            out.append((kind, q, q + n, r, {1: total, 4: m}.get(kind, min(m, total - m))))
        q += n if o in "M=XSI" else 0
        r += n if o in "M=XDN" else 0
        m += n if o in "M=X" else 0
    return out


def test_cigar_segments_and_pairs(spark):
    rng = random.Random(4)
    texts = ["100S200M", "99S200M100S", "10H120S50M130I70M100S", "300M", ""]
    texts += ["".join(f"{rng.randrange(1, 160)}{rng.choice('MIDNSX=')}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in df.select("c", cg.segments(F.col("c"), F.lit(1000), 100).alias("s"), cg.aligned_pairs(F.col("c"), F.lit(7)).alias("p"), cg.mapped_length(F.col("c")).alias("n")).collect():
        assert [(s.seg_type, s.query_start, s.query_end, s.ref_position, s.overhang) for s in r.s] == _walk(r.c, 1000, 100)
        want, q, t = [], 0, 7
        for n, o in ((int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r.c)):
            for _ in range(n):
                if o in "M=X":
                    want.append((q, t))
                elif o == "I":
                    want.append((q, None))
                elif o in "DN":
                    want.append((None, t))
                q, t = q + (o in "M=XSI"), t + (o in "M=XDN")
        assert [(p.q, p.r) for p in r.p] == want
    row = spark.range(1).select(cg.query_range(F.lit("10S80M5S"), F.lit(True)).alias("r"), cg.query_range(F.lit("10S80M5S"), F.lit(False)).alias("f")).first()
    assert tuple(row.r) == (5, 85) and tuple(row.f) == (10, 90)


def test_scoring_runs(spark):
    assert runs.scoring_runs("A" * 12) == [(11, 12)]
    assert runs.scoring_runs("AAAA") == [] and runs.scoring_runs("") == []
    assert runs.scoring_runs("C" + "A" * 10 + "CCCC" + "A" * 9) == [(10, 10), (23, 9)]
    assert runs.scoring_runs("A" * 8 + "T" + "A" * 8) == [(16, 17)]
    got = runs.with_scoring_runs(spark.createDataFrame([("A" * 9,), (None,), ("",)], "s string"), "s").collect()
    assert [r.runs if r.runs is None else [tuple(x) for x in r.runs] for r in got] == [[(8, 9)], None, []]
    assert runs.flank_run("CCGG" + "T" * 12, "T", True) and not runs.flank_run("T" * 12 + "CGCGCGCG", "T", True)
    assert runs.flank_run("A" * 14 + "CGCG", "A", False) and not runs.flank_run("A" * 14 + "CGCG", "A", False, strict_compat=True)
    text = "aab\n\nßß😀"
    r = spark.createDataFrame([(text,)], "t string").select(runs.run_lengths(F.col("t")).alias("r")).first().r
    assert [(x.base, x.len) for x in r] == [("a", 2), ("b", 1), ("\n", 2), ("ß", 2), ("😀", 1)]


def test_votes_and_length_mode(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("b", "x")], "k string, v string")
    assert {r.k: (r.v, r.n) for r in consensus.vote(df, ["k"], "v").collect()} == {"a": ("y", 2), "b": ("x", 1)}
    rows = [("tie", 5), ("tie", 3), ("more", 5), ("more", 5), ("more", 3), ("none", 7)]
    got = {r.k: r.length for r in consensus.length_mode(spark.createDataFrame(rows, "k string, n int"), ["k"], "n", 3).collect()}
    assert got == {"tie": 3, "more": 5, "none": 7}


def test_letters_are_counted_in_bounded_pieces(spark, monkeypatch):
    rng, most = random.Random(6), []
    rows = [(rng.choice(["x", "y", None]), "".join(rng.choice("abé😀") for _ in range(rng.randrange(0, 90)))) for _ in range(60)] + [("x", None), ("y", "ab" * 400), ("z", "")]
    monkeypatch.setattr(consensus, "LETTERS", 50)
    got = consensus.vote(consensus.position_counts(spark.createDataFrame(rows, "k string, t string"), "k", "t"), ["k", "pos"], "ch", "n")
    seen = {}
    for k, t in rows:
        for i, c in enumerate(t or "", 1):
            seen.setdefault((k, i), []).append(c)
    assert {(r.k, r.pos): (r.ch, r.n) for r in got.collect()} == {at: min(((c, x.count(c)) for c in x), key=lambda v: (-v[1], v[0])) for at, x in seen.items()}
    for _, starts, parts in consensus._stretches(pa.array([t for _, t in rows]), 50):
        most.append(sum(map(len, parts)))
        assert len(starts) == len(parts)
    assert max(most) == 50 and sum(most) == sum(len(t or "") for _, t in rows)


def test_recalibration():
    assert consensus.recalibrate(["AAA", "C", "GG"], {}) == "AAACGG"
    assert consensus.recalibrate(["AAA", "C", "GG"], {0: [("AAAA", 0)] * 3, 1: [("CC", 0)] * 3, 2: [("G", 0)] * 3}) == "AAAACG"  # the region after a change is copied
    assert consensus.recalibrate(["AAA", "C"], {0: [("AAAA", 0), ("AAA", 0)]}) == "AAAC"  # the reference length wins ties
    assert consensus.recalibrate(["A" * 21], {0: [("A", 0)] * 9}) == "A" * 21
    assert consensus.recalibrate(["AA", "CC", "GG"], {0: [("", 0)] * 3, 1: [("C", 0)] * 3}) == "CCGG"


def test_flags(spark):
    df = spark.range(1 << 12).select((F.col("id") * 48271 % (1 << 26)).alias("flag"))
    for r in df.select("flag", *flags.decoded(F.col("flag"))).collect():
        has = lambda n, f=r.flag: bool(f & flags.BIT[n])
        assert r.passed == has("PASS") and r.solo_ltr == has("SOLO_LTR")
        assert (r.truncation == "full") == (has("5P_FULL") and has("3P_FULL"))
        assert r.te_class == next((c for n, c in (("DNA", "DNA"), ("LTR", "LTR"), ("LINE", "LINE"), ("SINE", "SINE"), ("RETROPOSON", "Retroposon")) if has(n)), "unknown")
    g = spark.createDataFrame([(0.1999999,), (0.2,), (0.7999999,), (0.8,), (0.5,)], "f double").select(flags.genotype(F.col("f")).alias("g")).collect()
    assert [r.g for r in g] == ["0/1", "0/1", "1/1", "1/1", "0/1"]


def test_alignment_and_polish(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("ACGT") for _ in range(600))
    hit = seqjoin.best_alignment("TTTTTTT" + t[100:300] + "GG" + t[300:450], t)
    assert (hit["t_start"], hit["t_end"]) == (100, 450) and "2I" in hit["cigar"] and hit["nm"] == 2
    assert seqjoin.best_alignment("A" * 50, "C" * 50) is None and seqjoin.align_local("", "A", 0) is None
    bad = t[:200] + ("A" if t[200] != "A" else "C") + t[201:400] + t[402:]
    assert assembly.polish(bad, [t, t, t]) == t
    q = spark.createDataFrame([("f", t[50:250]), ("r", seqjoin_rc(t[50:250])), ("none", "ACGT" * 40)], "q_id string, q_seq string")
    got = {r.q_id: (r.strand, r.t_start, r.t_end) for r in seqjoin.align(q, spark.createDataFrame([("t", t)], "t_id string, t_seq string")).collect()}
    assert got == {"f": (0, 50, 250), "r": (1, 50, 250)}


def test_all_reads_of_a_cluster_vote(spark):
    rng = random.Random(6)
    t = "".join(rng.choice("ACGT") for _ in range(90))
    bad = t[:40] + ("A" if t[40] != "A" else "C") + t[41:]
    longer = t[:60] + "GATTACA" + t[60:]
    rows = [("deep", i, bad if i < 70 else t, i == 0) for i in range(200)]  # most reads have greater numbers
    rows += [("same", i, bad if i in (1, 2, 3) else t, i == 0) for i in range(8)]  # most reads equal the draft
    rows += [("insert", i, longer if i > 80 else t, i == 3) for i in range(170)]
    rows += [("alone", 7, "ACGNT", False)] + [("mixed", i, t[i % 5 :] if i % 3 else bad, i == 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, seg_id long, seq string, is_rep boolean")
    got = {r.k: (r.assembly, r.is_assembled) for r in assembly.assemble(df, ["k"]).collect()}
    mixed = [r for r in rows if r[0] == "mixed"]
    want = assembly.polish(mixed[2][2], [r[2] for r in mixed if not r[3]])
    assert got == {"deep": (t, True), "same": (t, True), "insert": (longer, True), "alone": ("ACGT", False), "mixed": (want, True)}


def seqjoin_rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_site_duplication(spark):
    cases = {(100, 100, 108, 100): (3, True, 100, 108), (100, 100, None, 100): (2, False, 99, 100), (100, 100, 108, None): (1, False, 107, 108), (100, 100, None, None): (0, False, 100, 100), (100, 100, 900, 100): (2, False, 99, 100), (100, 100, 95, 105): (3, False, 95, 105)}
    df = spark.createDataFrame(list(cases), "a int, b int, l int, r int")
    for r in df.select("*", annotate.tsd(F.col("a"), F.col("b"), F.col("l"), F.col("r")).alias("c")).collect():
        assert tuple(r.c) == cases[(r.a, r.b, r.l, r.r)]


def test_sequence_expressions(spark):
    s = F.lit("ACGTNACGT")
    r = spark.range(1).select(
        sequences.sub(s, F.lit(-3), F.lit(2)).alias("a"), sequences.sub(s, F.lit(7), F.lit(99)).alias("b"), sequences.sub(s, F.lit(20), F.lit(30)).alias("c"), sequences.reverse_complement(s).alias("d"),
        sequences.padded(s, F.lit(True), F.lit(False), 2).alias("e"), sequences.without_n(s).alias("f"), sequences.joined_ends(F.lit("A"), F.lit("C"), 3).alias("g"), sequences.min_edge(F.lit(39)).alias("h"),
    ).first()
    assert tuple(r) == ("AC", "GT", "", "ACGTNACGT", "ACGTNACGTNN", "ACGTACGT", "ANNNC", 3)


def test_a_failing_model_ends_the_query(spark):
    def broken(features):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        scoring.scored(spark.createDataFrame([(1, 2.0)], "k int, x double"), broken, ["k"], ["x"]).collect()


def test_cluster_statistics(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (0, 0, 0), (4, 4, 4)], "l int, m int, r int")
    for r in df.select("*", clusters.entropy(F.col("l"), F.col("m"), F.col("r")).alias("e"), clusters.balance(F.col("l"), F.col("r")).alias("b")).collect():
        import math

        n = r.l + r.m + r.r
        assert abs((r.e or 0) - -sum(x / n * math.log2(x / n) for x in (r.l, r.m, r.r) if x)) < 1e-12
    modes = spark.createDataFrame([(5,), (3,), (5,), (3,), (9,)], "p int").agg(clusters.modal("p").alias("m")).first()
    assert modes.m == 3 and Counter([5, 3, 5, 3, 9]).most_common(1)[0][1] == 2


def test_cigar_walks_are_those_of_a_plain_loop(spark):
    import random
    import re

    from strandflow.functions import cigar as cg

    rng = random.Random(4)
    texts = [None, "", "*", "12", "5S", "3H4S5M"] + ["".join(f"{rng.randrange(0, 60)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cigar string").repartition(3)
    got = {r.i: r for r in df.select("i", cg.segments(F.col("cigar"), F.lit(1000), 20).alias("s"), cg.aligned_pairs(F.col("cigar"), F.lit(1000)).alias("p"), cg.pair_totals(F.col("cigar"), F.lit(1000)).alias("t")).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i].s is None and got[i].p is None
            continue
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text)]
        total, q, r, m, segs, pairs = sum(n for n, o in ops if o in "M=X"), 0, 1000, 0, [], []
        for k, (n, o) in enumerate(ops):
            kind = 1 if k == 0 else 4 if k == len(ops) - 1 else 2
            if o in "SI" and n >= 20:
                segs.append((kind, q, q + n, r, m, {1: total, 4: m, 2: min(m, total - m)}[kind], total, k))
            if o in "MIDN=X":
                pairs += [(None if o in "DN" else q + x, None if o == "I" else r + x) for x in range(n)]
            q, r, m = q + n * (o in "M=XSI"), r + n * (o in "M=XDN"), m + n * (o in "M=X")
        assert [tuple(s) for s in got[i].s] == segs and [tuple(p) for p in got[i].p] == pairs
        both = [(a, b) for a, b in pairs if a is not None and b is not None]
        none = lambda x, over: sum(x) if over else None
        qs, rs = [a for a, _ in pairs if a is not None], [b for _, b in pairs if b is not None]
        assert tuple(got[i].t) == (len(pairs), len(pairs) - len(qs), len(pairs) - len(rs), none(qs, qs), none(rs, rs), none([a * b for a, b in both], both))


def test_sorted_rows_are_in_order_over_partitions(spark):
    from strandflow.operators import merge

    df = spark.createDataFrame([((i * 7919) % 1000, i) for i in range(1000)], "a int, b int")
    assert [r.a for r in merge.sorted_rows(df, ["a"], 5).collect()] == list(range(1000))


def test_flank_runs_are_those_of_the_fold(spark):
    from strandflow.operators import runs

    rows = [(0, "AAAAAAAACGT"), (1, "CGTCGTCGTCGT"), (2, "CGCGTTTTTTTT"), (3, ""), (4, None)]
    got = {r.i: (r.at_start, r.at_end) for r in runs.with_flank_runs(spark.createDataFrame(rows, "i int, s string"), "s", 20).collect()}
    assert got == {0: (True, False), 1: (False, False), 2: (False, True), 3: (False, False), 4: (None, None)}


def test_read_homopolymers_follow_the_borders():
    draft = "GCAAATTCG"
    regions = consensus.polymers(draft)
    assert regions == [(0, 0), (1, 1), (2, 4), (5, 6), (7, 7), (8, 8)]
    shown = lambda read, cigar: {k: (t, x) for k, t, x in consensus.read_polymers(draft, regions, read, {"q_start": 0, "t_start": 0, "t_end": len(draft), "cigar": cigar})}
    assert {k: t for k, (t, _) in shown(draft, "9M").items()} == {0: "G", 1: "C", 2: "AAA", 3: "TT", 4: "C", 5: "G"}
    assert shown("GCAAAATTCG", "2M1I7M")[2] == ("AAAA", 0)  # inserted beside the run
    assert shown("GCAATTCG", "2M1D6M")[2] == ("AA", 0)  # its first base is deleted
    assert shown("GAAATTCG", "1M1D7M")[1] == ("", 0) and shown("GCTTCG", "2M3D4M").get(2) is None
    assert shown("GCAAATTCG", "9M")[1] == ("C", 0) and consensus.read_polymers("AAC", [(0, 1), (2, 2)], "AAAC", {"q_start": 1, "t_start": 0, "t_end": 3, "cigar": "1S3M"})[0] == (0, "AA", 1)


def test_chains_of_runs_are_those_of_seeds(spark):
    rng = random.Random(21)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = dna(80)
    tail = lambda n, c="A": dna(rng.randrange(3)) + c * n
    q = [(i, x) for i, x in enumerate([core + tail(90), tail(200) + core, dna(50) + "T" * 40, "A" * 11, "A" * 10, "", "ACACACACACACACACAC" * 4, core + "N" + core, tail(30) + tail(12, "C") + tail(25)])]
    t = [(i, x) for i, x in enumerate([core + tail(30), "A" * 300, "T" * 13 + dna(30), "CACACACACACACACA", tail(12, "C")])]
    a, b = spark.createDataFrame(q, "q_id int, q_seq string"), spark.createDataFrame(t, "t_id int, t_seq string")
    names = ["q_id", "t_id", "strand", "diag", "n_seeds", "q_lo", "q_hi", "t_lo", "t_hi"]
    for band in (64, 7):
        shown = lambda df: sorted(tuple(r[n] for n in names) for r in df.collect())
        want = shown(seqjoin.chains(seqjoin.seeds(a, b), band))
        assert len(want) > 20 and shown(seqjoin.chained(a, b, band=band)) == want


def test_interval_joins_cut_hot_places_and_long_intervals(spark, monkeypatch):
    monkeypatch.setattr(intervals, "RANGE_ROWS", 40)
    rng = random.Random(9)
    q = [("x", s, s + rng.randrange(0, 90), i) for i, s in enumerate(rng.randrange(3000) for _ in range(300))]
    q += [("x", 1500, 1500 + i % 3, 300 + i) for i in range(600)]  # most queries at one place
    q += [("x", 0, 3000, 900), ("y", 5, 5, 901), ("z", 1, 2, 902), (None, 1, 2, 903), ("x", None, 2, 904)]
    iv = [("x", s, s + rng.randrange(1, 400), i) for i, s in enumerate(rng.randrange(3000) for _ in range(120))]
    iv += [("x", 0, 5000, 120), ("x", 1, 4999, 121), ("x", 1500, 1500, 122), ("x", 1500, 1500, 123), ("y", 5, 5, 124), ("y", 0, 9, 125), (None, 0, 9, 126), ("x", None, 9, 127)]
    a, b = spark.createDataFrame(q, "k string, start long, end long, id long"), spark.createDataFrame(iv, "k string, i_start long, i_end long, rep long")
    for slack in (0, 3, 50):
        hits = {i: [(u, v, j) for m, u, v, j in iv if k == m and k and None not in (s, u) and u < e + slack and v > max(s - slack, 0)] for k, s, e, i in q}
        pairs = intervals.overlap_pairs(a, b, "k", slack)
        assert sorted((r.id, r.rep) for r in pairs.collect()) == sorted((i, j) for i, h in hits.items() for _, _, j in h)
        for r in intervals.interval_overlaps(a, b, "k", ["id"], slack, None, "rep").collect():
            h, (_, s, e, _) = hits[r.id], q[r.id]
            assert r.n == len(h) and r.rep == (max(h, key=lambda x: (x[0], x[1], -x[2]))[2] if h else None)
            assert r.min_dist == (min(abs(x - y) for u, v, _ in h for x in (s, e) for y in (u, v)) if h else None)
    left, right = intervals._dealt(a.withColumns({"_lo": F.col("start"), "_hi": F.col("end")}), b.withColumns({"_s": F.col("i_start"), "_e": F.col("i_end")}), "k")
    sizes = [r["count"] for r in left.groupBy("k", "_part", "_copy").count().collect()]
    assert max(sizes) < 200 and sum(sizes) < 1.2 * len(q)  # the hot place is split, and few queries touch two stretches
    assert len(right.where("rep = 120 and _copy = 0").select("_part").distinct().collect()) == right.where("k = 'x'").select("_part").distinct().count()


def test_lists_have_no_containment():
    from strandflow.operators.intervals import Lists

    rng = np.random.default_rng(3)
    s = rng.integers(0, 100, 400)
    e = s + rng.integers(0, 60, 400)
    found = Lists(s, e).lists
    assert sorted(i for _, _, at in found for i in at) == list(range(400))
    assert all((np.diff(a) >= 0).all() and (np.diff(b) > 0).all() for a, b, _ in found)
    assert Lists(s[:0], e[:0]).lists == [] and len(Lists(np.arange(50), np.arange(50) + 5).lists) == 1


def test_equal_intervals_and_queries_are_one_row_of_the_join(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(intervals, "_dealt", lambda q, i, key, dealt=intervals._dealt: sizes.append((q.count(), i.count())) or dealt(q, i, key))
    q = [("x", 10 + i % 2, 12 + i % 2, i) for i in range(400)] + [("x", 90, 91, 400), (None, 1, 2, 401)]
    iv = [("x", 5 + i % 3, 12, 1000 - i) for i in range(300)] + [("x", 13, 13, 7), ("x", 13, 13, 3)]
    a, b = spark.createDataFrame(q, "k string, start long, end long, id long"), spark.createDataFrame(iv, "k string, i_start long, i_end long, rep long")
    near = lambda k, lo, hi: [(u, v, r) for m, u, v, r in iv if k == m and u < hi + 2 and v > max(lo - 2, 0)]
    least = lambda hits, *at: min((abs(x - y) for u, v, _ in hits for x in at for y in (u, v)), default=None)
    spans = {i: near(k, s, e) for k, s, e, i in q}
    got = {r.id: (r.n, r.min_dist, r.rep) for r in intervals.interval_overlaps(a, b, "k", ["id"], 2, None, "rep").collect()}
    assert got == {i: (len(spans[i]), least(spans[i], s, e), 3 if spans[i] else None) for _, s, e, i in q}
    points = {r.id: (r.n, r.min_dist) for r in intervals.point_overlaps(a, b, "k", "start", ["id"], 2).collect()}
    assert points == {i: (len(h := near(k, s, s)), least(h, s)) for k, s, _, i in q}
    assert {r.id for r in intervals.semi(a, b, "k", ["id"], 2).collect()} == set(range(400))
    assert {r.id for r in intervals.semi(a, b, "k", ["id"], 2, how="left_anti").collect()} == {400, 401}
    assert len(sizes) == 4 and all(n <= 4 and m <= 4 for n, m in sizes), sizes
