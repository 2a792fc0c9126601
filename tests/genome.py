"""A small genome with planted insertions: positions, elements, target site duplications and genotypes are known."""

import random

FLIP = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.translate(FLIP)[::-1]


def make(seed: int = 11):
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    chrom = {"chrA": dna(60_000), "chrB": dna(20_000)}
    ltr = dna(250)
    te = {"L1x": ("LINE", dna(1200)), "ERVx": ("LTR", ltr + dna(700) + ltr), "hATx": ("DNA", dna(900))}
    # position, element, reverse, tail of A, site duplication, reads with and without
    plan = [("chrA", 10_000, "L1x", False, 30, 12, 8, 0), ("chrA", 25_000, "hATx", False, 0, 8, 4, 4), ("chrA", 40_000, "L1x", True, 30, 10, 8, 0), ("chrB", 9_000, "ERVx", False, 0, 6, 3, 5)]
    alignments, reads, truth = [], [], []
    k = 0
    for name, pos, family, reverse, tail, tsd, with_, without in plan:
        ref = chrom[name]
        body = te[family][1] + "A" * tail
        body = rc(body) if reverse else body
        allele = ref[:pos] + body + ref[pos - tsd : pos] + ref[pos:]
        tid = list(chrom).index(name)
        truth.append({"chrom": name, "pos": pos, "family": family, "strand": "-" if reverse else "+", "tsd": ref[pos - tsd : pos], "n": with_, "ref": without})
        for i in range(with_):
            a, b = pos - 1500 - 37 * i, pos + 1500 + 29 * i
            seq = ref[a:pos] + body + ref[pos - tsd : pos] + ref[pos:b]
            assert seq in allele
            alignments.append((k, f"r{k}", 0, tid, a, 60, f"{pos - a}M{len(body) + tsd}I{b - pos}M", len(body) + tsd, 0, 2000, len(seq)))
            reads.append((k, f"r{k}", seq))
            k += 1
        for i in range(without):
            a, b = pos - 1300 - 31 * i, pos + 1400 + 23 * i
            alignments.append((k, f"r{k}", 0, tid, a, 60, f"{b - a}M", 0, 0, 2 * (b - a), b - a))
            reads.append((k, f"r{k}", ref[a:b]))
            k += 1
    for tid, (_name, ref) in enumerate(chrom.items()):  # plain coverage
        for a in range(0, len(ref) - 3000, 1000):
            if all(abs(a + 1500 - p[1]) > 4000 or list(chrom).index(p[0]) != tid for p in plan):
                alignments.append((k, f"r{k}", 0, tid, a, 60, "3000M", 0, 0, 6000, 3000))
                reads.append((k, f"r{k}", ref[a : a + 3000]))
                k += 1
    # records that must not count: unmapped, secondary
    alignments += [(k, "bad1", 4, 0, 10_000, 0, "1000M500S", 0, 0, 0, 1500), (k + 1, "bad2", 256, 0, 10_000, 0, "1000M500S", 0, 0, 0, 1500)]
    reads += [(k, "bad1", "A" * 1500), (k + 1, "bad2", "A" * 1500)]
    return chrom, te, alignments, reads, truth


def tables(spark, seed: int = 11):
    from strandflow.functions import flags
    from strandflow.plans.caller import Tables, ltr_lengths

    chrom, te, alignments, reads, truth = make(seed)
    contigs = spark.createDataFrame([(i, n, len(s)) for i, (n, s) in enumerate(chrom.items())], "tid int, name string, length int")
    refs = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(chrom.items())], "tid int, name string, seq string")
    te_rows = spark.createDataFrame([(i, n, c, flags.BIT[c], len(s), s) for i, (n, (c, s)) in enumerate(te.items())], "te_tid int, name string, te_class string, class_bit long, length int, seq string")
    te_rows = te_rows.join(ltr_lengths(te_rows), "te_tid", "left").fillna(0, ["ltr_len"])
    al = spark.createDataFrame(alignments, "aln_id long, qname string, flag int, tid int, pos int, mapq int, cigar string, nm int, nn int, aln_score int, read_len int")
    rd = spark.createDataFrame(reads, "aln_id long, qname string, seq string")
    iv = spark.createDataFrame([("chrA", 1000, 1500, "L1x", "repeat", 0), ("chrA", 50_000, 50_500, "gap", "gap", -1), ("chrB", 100, 200, "x", "blacklist", -1)], "contig string, start int, end int, name string, kind string, rep_tid int")
    return Tables(contigs, refs, te_rows, al, rd, iv), truth
