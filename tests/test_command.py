import pytest
from genome import make

from strandflow import __main__ as command
from strandflow.plans import files
from strandflow.sources import bam


def written(tmp_path, seed=12):
    chrom, te, alignments, reads, truth = make(seed)
    seqs = {k: s for k, _, s in reads}
    rows = [{"qname": q, "flag": f, "tid": t, "pos": p, "mapq": m, "cigar": c, "seq": seqs[k], "nm": nm, "nn": nn, "aln_score": s} for k, q, f, t, p, m, c, nm, nn, s, _ in alignments]
    bam.write_bam(str(tmp_path / "a.bam"), [(n, len(s)) for n, s in chrom.items()], rows, str(tmp_path / "a.bai"), block=9000)
    (tmp_path / "ref.fa").write_text("".join(f">{n} made up\n{s}\n" for n, s in reversed(chrom.items())))  # not in the order of the header
    (tmp_path / "te.fa").write_text("".join(f">{n}\n{s}\n" for n, (_, s) in te.items()))
    (tmp_path / "te.class").write_text("".join(f"{n}\t{c}\n" for n, (c, _) in te.items()))
    (tmp_path / "r.bed").write_text("chrA\t1000\t1500\tL1x\n")
    (tmp_path / "g.bed").write_text("chrA\t50000\t50500\tgap\n")
    (tmp_path / "b.bed").write_text("chrB\t100\t200\tx\n")
    at = lambda n: str(tmp_path / n)
    return ["-b", at("a.bam"), "-i", at("a.bai"), "-C", at("te.class"), "-T", at("te.fa"), "-R", at("ref.fa"), "-r", at("r.bed"), "-g", at("g.bed"), "-B", at("b.bed"), "-o", at("out")]


def test_files_give_all_planted_sites(spark, tmp_path, capsys):
    argv = written(tmp_path)
    command.main(argv)
    assert "4 insertions" in capsys.readouterr().out
    got = spark.read.csv(str(tmp_path / "out/result"), sep="\t", header=True).collect()
    shown = sorted((r.chrom, r.family, r.strand, r.tsd_seq, r.genotype, int(r.total_support)) for r in got)
    assert shown == sorted((w["chrom"], w["family"], w["strand"], w["tsd"], "0/1" if w["ref"] else "1/1", w["n"]) for w in make(12)[-1])
    assert all(abs(int(r.start) - w["pos"]) <= 60 for r, w in zip(sorted(got, key=lambda r: (r.chrom, int(r.start))), make(12)[-1], strict=True))


def test_ids_of_alignments_are_small_and_in_order(spark, tmp_path):
    argv = written(tmp_path)
    rows = bam.read_bam(spark, argv[1]).select("file_offset", files.alignment_id(bam.F.col("file_offset")).alias("i")).orderBy("file_offset").collect()
    ids = [r.i for r in rows]
    assert ids == sorted(set(ids)) and max(ids) < 1 << 32
    far = spark.createDataFrame([((1 << 38) << 16 | 65_000,)], "o long").select(files.alignment_id(bam.F.col("o")).alias("i")).first().i
    assert 0 < far * 65_536 + 65_535 < 1 << 63


@pytest.mark.parametrize("more", [["-n", "100"], ["-d", "0"], ["-e", "-1"], ["-l", "0"], ["-O", "-5"]])
def test_bad_options(tmp_path, more):
    with pytest.raises(ValueError):
        command.main(["-b", "x", "-C", "x", "-T", "x", "-R", "x", *more])


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        command.main([*written(tmp_path), "-r", str(tmp_path / "none.bed")])
