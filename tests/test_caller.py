from genome import tables
from strandflow.plans import caller
from strandflow.sources.text import RESULT


def test_result_schema_and_all_planted_sites(spark):
    t, truth = tables(spark, 12)
    df = caller.call(t)
    assert set(RESULT) <= set(df.columns)
    rows = df.collect()
    for w in truth:
        near = [r for r in rows if r.chrom == w["chrom"] and abs(r.start - w["pos"]) <= 60]
        assert len(near) == 1 and w["family"] in near[0].family and near[0].strand == w["strand"]
        assert near[0].tsd_seq == w["tsd"], (near[0].tsd_seq, w)
        assert near[0].passed and near[0].total_support == w["n"] and near[0].genotype == ("0/1" if w["ref"] else "1/1")
        assert near[0].extra_info.startswith(f"insID={near[0].insertion_id},leftClipReads=0,spanningReads={w['n']},")


def test_nothing_to_find_gives_the_schema(spark):
    t, _ = tables(spark)
    t.alignments = t.alignments.where("cigar not like '%I%'")
    df = caller.call(t)
    assert set(RESULT) <= set(df.columns) and df.count() == 0


def clipped(spark, seed, sides):
    """One insertion of L1x at 30,000 of a contig that no read spans; `sides`: reads that end in it, and that begin in it or reach 90 bases beyond it, all clipped there."""
    import random

    from genome import rc  # noqa: F401
    from strandflow.functions import flags

    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    ref, te, pos, tsd = dna(60_000), dna(1600), 30_000, 12
    # the bases beside the site differ from the insertion's ends (its first base, and the tail's A): else two sites would explain the reads as well
    ref = f"{ref[: pos - tsd - 1]}C{ref[pos - tsd : pos]}{'G' if te[0] == 'C' else 'C'}{ref[pos + 1 :]}"
    body = te + "A" * 30
    allele = ref[:pos] + body + ref[pos - tsd : pos] + ref[pos:]
    alignments, reads, k = [], [], 0

    def add(seq, at, cigar):
        nonlocal k
        alignments.append((k, f"r{k}", 0, 0, at, 60, cigar, 0, 0, 2000, len(seq)))
        reads.append((k, f"r{k}", seq))
        k += 1

    for i in range(6):
        if "ends" in sides:
            a = pos - 1500 - 37 * i
            add(allele[a : pos + 700 + 5 * i], a, f"{pos - a}M{700 + 5 * i}S")
        if "begins" in sides:
            n = 700 + 7 * i
            add(allele[pos + len(body) - n : pos + len(body) + tsd + 1500 + 29 * i], pos - tsd, f"{n}S{tsd + 1500 + 29 * i}M")
        if "beyond" in sides:
            a = pos - 1500 - 37 * i
            add(allele[a : pos + len(body) + tsd + 90], a, f"{pos - a}M{len(body) + tsd + 90}S")
    for a in range(0, len(ref) - 3000, 1000):
        if abs(a + 1500 - pos) > 4000:
            add(ref[a : a + 3000], a, "3000M")
    t, _ = tables(spark)
    t.contigs = spark.createDataFrame([(0, "chrZ", len(ref))], "tid int, name string, length int")
    t.refs = spark.createDataFrame([(0, "chrZ", ref)], "tid int, name string, seq string")
    t.te = spark.createDataFrame([(0, "L1x", "LINE", flags.BIT["LINE"], len(te), te, 0)], "te_tid int, name string, te_class string, class_bit long, length int, seq string, ltr_len int")
    t.alignments = spark.createDataFrame(alignments, t.alignments.schema)
    t.reads = spark.createDataFrame(reads, t.reads.schema)
    t.intervals = t.intervals.where("1 = 0")
    return t, ref, te, pos, tsd


def test_ends_on_two_contigs(spark):
    t, ref, te, pos, tsd = clipped(spark, 5, ("ends", "begins"))
    rows = caller.call(t).collect()
    assert len(rows) == 1
    r = rows[0]
    assert "reconstructedEnds=both_end" in r.extra_info and r.family == "L1x" and r.strand == "+"
    assert r.tsd_seq == ref[pos - tsd : pos] and abs(r.start - pos) <= 60
    left, right = r.insertion_seq.split("N" * 500)
    assert te.startswith(left[:600]) and right.rstrip("A").endswith(te[-50:].rstrip("A"))
    assert r.upstream_seq[-50:] == ref[pos - 50 : pos] and r.downstream_seq != "."


def test_one_flank_is_rescued_by_the_contigs_other_end(spark):
    t, ref, te, pos, tsd = clipped(spark, 6, ("beyond",))
    r = caller.call(t).collect()[0]
    assert "reconstructedEnds=both_end" in r.extra_info and r.insertion_seq[:1600] == te and r.insertion_seq[1600:].strip("A") in ("", ref[pos - tsd : pos])
    t, ref, te, pos, tsd = clipped(spark, 7, ("ends",))
    r = caller.call(t).collect()[0]
    assert "reconstructedEnds=only_left" in r.extra_info and r.downstream_seq == "." and r.insertion_seq.endswith("N" * 50)


def test_batch_models_can_be_given(spark, tmp_path):
    import json

    from strandflow.functions import scoring

    t, truth = tables(spark, 12)
    (tmp_path / "m.json").write_text(json.dumps({"weights": {"num_seg_raw": 0.0}, "bias": 9.0}))
    (tmp_path / "n.json").write_text(json.dumps({"weights": {"num_seg_raw": 0.0}, "bias": -9.0}))
    yes, no = scoring.load(str(tmp_path / "m.json")), scoring.load(str(tmp_path / "n.json"))
    built, _ = caller.build(t, caller.CallerConfig(), yes, no)
    p = {(r.clt_type == 0): round(r.probability, 3) for r in built.where("te_aligned_frac >= 0.8 and not is_in_blacklist").collect()}
    assert p.pop(True) == 1.0 and set(p.values()) <= {0.0}


def test_clusters_of_one_read_keep_it(spark):
    import random

    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    one, many = dna(900), dna(900)
    t, _ = tables(spark)
    t.reads = spark.createDataFrame([(0, "a", one), *((i, f"b{i}", many) for i in (1, 2, 3))], t.reads.schema)
    good = spark.createDataFrame([(0, 0, 1, 0, 2, 0, 2), (0, 1, 10, 0, 3, 0, 0)], "tid int, idx long, rep_seg_id long, num_left int, num_middle int, num_right int, clt_type int")
    segs = spark.createDataFrame([(0, 0, 0, 0, 2, 100, 200), (0, 0, 1, 0, 2, 500, 650), *((0, 1, 10 * i, i, 2, 300, 600) for i in (1, 2, 3))], "tid int, idx long, seg_id long, aln_id long, seg_type int, query_start int, query_end int")
    got = {r.idx: r.contigs for r in caller.assemblies(good, segs, t, caller.CallerConfig()).collect()}
    assert [(x.contig, x.assembly, x.is_assembled) for x in got[0]] == [(0, one, False)]
    assert [(x.contig, x.assembly, x.is_assembled) for x in got[1]] == [(0, many, True)]
