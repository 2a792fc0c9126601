import random

import pytest

from strandflow.sources import bam, text


def test_fasta_bed_and_classes(spark, tmp_path):
    (tmp_path / "te.fa").write_text(">L1x extra words\nACGT\nacgt\n>ERV\r\nTT\r\nGG\r\n>hAT\nA\n")
    te = text.read_fasta(spark, str(tmp_path / "te.fa"))
    assert [(r.ordinal, r.name, r.seq, r.length) for r in te.orderBy("ordinal").collect()] == [(0, "L1x", "ACGTACGT", 8), (1, "ERV", "TTGG", 4), (2, "hAT", "A", 1)]
    (tmp_path / "r.bed").write_text("chr1\t10\t20\tERV\nchr1\t30\t20\tERV\nchr2\t5\t5\tnew\n")
    assert sorted((r.contig, r.start, r.end, r.rep_tid) for r in text.read_bed(spark, str(tmp_path / "r.bed"), te).collect()) == [("chr1", 10, 20, 1), ("chr2", 5, 5, -1)]
    (tmp_path / "bad.bed").write_text("chr1\t10\t20\n")
    with pytest.raises(Exception, match="has no name"):
        text.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "te.class").write_text("ERV  LTR\nL1x LINE\nhAT Other\n")
    assert {r.name: r.class_bit for r in text.read_classes(spark, str(tmp_path / "te.class"), te).collect()} == {"L1x": 1 << 15, "ERV": 1 << 18, "hAT": 0}
    (tmp_path / "short.class").write_text("ERV LTR\n")
    with pytest.raises(Exception, match="no class for element"):
        text.read_classes(spark, str(tmp_path / "short.class"), te).collect()
    tile = text.tiles(te, 4, 2).where("name = 'L1x'").orderBy("tile").collect()
    assert [(t.offset, t.seq) for t in tile] == [(0, "ACGTAC"), (4, "ACGT")]


def test_bam_round_trip_with_and_without_index(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        n = rng.randrange(1, 400)
        rows.append({"qname": f"read{i}", "flag": rng.choice([0, 16, 256]), "tid": rng.choice([0, 1, 1, 2]), "pos": rng.randrange(100_000), "mapq": rng.randrange(61), "cigar": f"{n}M3D5S", "seq": "".join(rng.choice("ACGTN") for _ in range(n + 5)), "nm": rng.randrange(300) if i % 3 else None, "nn": 0, "aln_score": -7 * i})
    path, index = str(tmp_path / "a.bam"), str(tmp_path / "a.bam.bai")
    bam.write_bam(path, [("one", 200_000), ("two", 150_000), ("three", 120_000), ("empty", 5)], rows, index, block=3000)
    want = sorted((r["qname"], r["flag"], r["tid"], r["pos"], r["mapq"], r["cigar"], r["seq"], r["nm"], r["nn"], r["aln_score"]) for r in rows)
    shown = lambda df: sorted((r.qname, r.flag, r.tid, r.pos, r.mapq, r.cigar, r.seq, r.nm, r.nn, r.aln_score) for r in df.collect())
    assert shown(bam.read_bam(spark, path)) == want
    split = bam.read_bam(spark, path, index)
    assert shown(split) == want and split.rdd.getNumPartitions() == 3
    assert shown(bam.read_bam(spark, path, index, 1)) == [r for r in want if r[2] == 1]
    assert [(r.tid, r.name, r.length) for r in bam.contigs(spark, path).collect()] == [(0, "one", 200_000), (1, "two", 150_000), (2, "three", 120_000), (3, "empty", 5)]
    (tmp_path / "no.bam").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError, match="not a BGZF block"):
        bam.contigs(spark, str(tmp_path / "no.bam"))


def test_bam_parts_regions_and_single_records(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [{"qname": f"r{i}", "flag": 0, "tid": rng.randrange(2), "pos": rng.randrange(0, 400_000), "mapq": 60, "cigar": "50M10I40M", "seq": "ACGT" * 25, "nm": 1, "nn": 0, "aln_score": 9} for i in range(3_000)]
    path, index = str(tmp_path / "a.bam"), str(tmp_path / "a.bai")
    bam.write_bam(path, [("one", 400_200), ("two", 400_200)], rows, index, block=3000)
    key = lambda df: sorted((r.qname, r.tid, r.pos) for r in df.collect())
    want = sorted((r["qname"], r["tid"], r["pos"]) for r in rows)
    split = bam.read_bam(spark, path, index, split_bytes=4_000)
    assert key(split) == want and split.rdd.getNumPartitions() > 8
    for beg, end in ((0, 1), (100_000, 130_000), (131_072, 131_073), (399_999, 500_000)):
        assert key(bam.read_bam(spark, path, index, 1, beg, end)) == [x for x in want if x[1] == 1 and x[2] < end and x[2] + 90 > beg]
    assert bam.read_bam(spark, path, index, 7).count() == 0
    some = split.where("pos % 7 = 0").select("file_offset")
    assert key(bam.fetch(some.unionByName(some.limit(0)), path)) == [x for x in want if x[2] % 7 == 0]


def _reads(rng, n, contigs=3, longest=400):
    rows = []
    for i in range(n):
        k = rng.randrange(1, longest)
        tid = rng.choice([-1, *range(contigs)])
        rows.append({"qname": f"read{i}", "flag": 4 if tid < 0 else 0, "tid": tid, "pos": -1 if tid < 0 else rng.randrange(100_000), "mapq": rng.randrange(61), "cigar": "" if tid < 0 else f"{k}M3D5S", "seq": "".join(rng.choice("ACGTN") for _ in range(k + 5)), "nm": rng.randrange(300) if i % 3 else None, "nn": 0, "aln_score": -7 * i})
    return rows


_SHOWN = ("qname", "flag", "tid", "pos", "mapq", "cigar", "seq", "nm", "nn", "aln_score")


def _shown(df):
    return sorted((tuple(r[c] for c in _SHOWN) for r in df.collect()), key=repr)


def test_bam_without_index_is_split_at_any_size(spark, tmp_path):
    rng = random.Random(7)
    rows = _reads(rng, 400)
    rows.append({**rows[0], "qname": "long", "tid": 1, "pos": 50_000, "cigar": "300000M", "seq": "".join(rng.choice("ACGT") for _ in range(300_000))})  # longer than many blocks
    path = str(tmp_path / "a.bam")
    bam.write_bam(path, [("one", 900_000), ("two", 900_000), ("three", 900_000)], rows, block=3000)
    want = sorted((tuple(r[c] for c in _SHOWN) for r in rows), key=repr)
    for size in (5_000, 17_001, 60_000, 1 << 30):
        split = bam.read_bam(spark, path, split_bytes=size)
        assert _shown(split) == want
        assert size > 1 << 20 or split.rdd.getNumPartitions() >= 3
    (tmp_path / "empty.bam").write_bytes(b"")
    bam.write_bam(path, [("one", 5)], [], block=3000)
    assert bam.read_bam(spark, path, split_bytes=10).count() == 0


def test_every_start_that_is_found_is_a_record(tmp_path):
    rng = random.Random(8)
    path = str(tmp_path / "a.bam")
    bam.write_bam(path, [("one", 900_000), ("two", 900_000), ("three", 900_000)], _reads(rng, 300), block=2_000)
    with bam._open(path) as f:
        contigs, first = bam.header(f)
        true = [r[0] for r in bam.records(bam.Bgzf(f, first))]
        size = f.size()
        for offset in range(0, size, 211):
            got = bam.first_record(f, size, offset, len(contigs))
            assert got == next((x for x in true if x >> 16 >= offset), size << 16)


def test_filters_reach_the_file(spark, tmp_path):
    rng = random.Random(9)
    rows = [r for r in _reads(rng, 2_000) if r["tid"] >= 0]
    path, index = str(tmp_path / "a.bam"), str(tmp_path / "a.bai")
    bam.write_bam(path, [("one", 200_000), ("two", 200_000), ("three", 200_000)], rows, index, block=3000)
    whole = bam.read_bam(spark, path, index, split_bytes=10_000)
    n = whole.rdd.getNumPartitions()
    want = lambda keep: sorted((tuple(r[c] for c in _SHOWN) for r in rows if keep(r)), key=repr)
    for filters, keep in (("tid = 1", lambda r: r["tid"] == 1), ("tid in (0, 2) and pos < 20000", lambda r: r["tid"] in (0, 2) and r["pos"] < 20_000), ("tid = 1 and pos >= 30000 and pos <= 50000", lambda r: r["tid"] == 1 and 30_000 <= r["pos"] <= 50_000), ("pos > 90000", lambda r: r["pos"] > 90_000)):
        some = bam.read_bam(spark, path, index, split_bytes=10_000).where(filters)
        assert _shown(some) == want(keep) and some.rdd.getNumPartitions() < n
    offsets = sorted(r.file_offset for r in whole.collect())
    some = bam.read_bam(spark, path, index, split_bytes=10_000).where(f"file_offset >= {offsets[700]} and file_offset < {offsets[760]}")
    assert sorted(r.file_offset for r in some.collect()) == offsets[700:760] and some.rdd.getNumPartitions() < n


def test_bam_is_written_by_tasks(spark, tmp_path):
    rng = random.Random(10)
    rows = _reads(rng, 1_500)
    df = spark.createDataFrame([tuple(r[c] for c in _SHOWN) for r in rows], "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, nm int, nn int, aln_score int").repartition(5)
    path, index = str(tmp_path / "out.bam"), str(tmp_path / "out.bam.bai")
    contigs = [("one", 200_000), ("two", 200_000), ("three", 200_000)]
    bam.save_bam(df, path, contigs, index)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out.bam", "out.bam.bai"]
    found = bam.read_bam(spark, path).collect()
    assert [(r.tid < 0, r.tid, r.pos) for r in sorted(found, key=lambda r: r.file_offset)] == sorted((r["tid"] < 0, r["tid"], r["pos"]) for r in rows)
    want = sorted((tuple(r[c] for c in _SHOWN) for r in rows), key=repr)
    assert _shown(bam.read_bam(spark, path, split_bytes=20_000)) == want
    assert _shown(bam.read_bam(spark, path, index, split_bytes=20_000)) == [r for r in want if r[2] >= 0]
    near = bam.read_bam(spark, path, index, 1, 40_000, 41_000)
    assert _shown(near) == [r for r in want if r[2] == 1 and r[3] < 41_000 and r[3] + bam._span(r[5]) > 40_000]
    bam.save_bam(df.where("1 = 0"), path, contigs, index)
    assert bam.read_bam(spark, path).count() == 0


def test_fasta_by_ranges(spark, tmp_path):
    from strandflow.sources import fasta

    rng = random.Random(11)
    seqs = {"one": "".join(rng.choice("ACGTacgt") for _ in range(10_007)), "empty": "", "two": "".join(rng.choice("ACGT") for _ in range(60)), "three": "ACGT" * 15}
    out, index = "", ""
    for name, s in seqs.items():
        out += f">{name} text\r\n"
        index += f"{name}\t{len(s)}\t{len(out)}\t60\t62\n"
        out += "".join(s[i : i + 60] + "\r\n" for i in range(0, len(s), 60))
    path = str(tmp_path / "a.fa")
    (tmp_path / "a.fa").write_bytes(out.encode())
    (tmp_path / "a.fa.fai").write_text(index)
    assert {r.name: r.length for r in text.read_fai(spark, f"{path}.fai").collect()} == {k: len(v) for k, v in seqs.items()}
    for size, overlap, split in ((100, 30, 1000), (4096, 100, 1), (1 << 16, 0, 1 << 20)):
        got = fasta.read_tiles(spark, path, size=size, overlap=overlap, split=split)
        want = text.tiles(text.read_fasta(spark, path), size, overlap)
        key = lambda df: sorted((r.name, r.tile, r.offset, r.seq) for r in df.collect())
        assert key(got) == key(want) and len(key(got)) == sum(max(1, -(-len(s) // size)) for s in seqs.values())
        assert split > 1 or got.rdd.getNumPartitions() > 3
    (tmp_path / "a.fa.fai").write_text(index.replace("10007", "10900"))
    with pytest.raises(Exception, match="doesn't fit"):
        fasta.read_tiles(spark, path, size=100).collect()
    (tmp_path / "a.fa.fai").write_text("one\tx\n")
    with pytest.raises(Exception, match="not a line"):
        fasta.read_index(f"{path}.fai")


def test_tiles_take_linear_time(spark):
    import time

    def took(n):
        df = spark.range(1).selectExpr("0 tid", f"repeat('ACGTTGCA', {n // 8}) seq")
        start = time.perf_counter()
        assert text.tiles(df, key="tid").count() == -(-n // 65_536)
        return time.perf_counter() - start

    took(1 << 20)
    assert took(64 << 20) < 20
