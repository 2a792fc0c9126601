"""The caller's tables from files: BAM with its index, FASTA, element classes, BED and JSON models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import Scratch
from ..sources import bam, fasta, text
from .caller import FLANK, TILE, Tables, ltr_lengths

#: Bits for a record's place in its block, in steps of 32 bytes; records have 36 at least, and blocks 28.
PLACE_BITS = 11


def alignment_id(offset: Column) -> Column:
    """A smaller number for a virtual file offset, one to one and in the same order, so that segments can be numbered by it (files up to 512 GB)."""
    block, place = F.shiftright(offset, 16), offset.bitwiseAND(F.lit(0xFFFF).cast("long"))
    small = F.shiftleft(F.shiftright(block, 4), PLACE_BITS).bitwiseOR(F.shiftright(place, 5))
    return F.when(block < F.lit(1 << 39), small).otherwise(F.raise_error(F.lit("the BAM file has more than 512 GB")))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def elements(spark: SparkSession, fasta: str, classes: str) -> DataFrame:
    te = text.read_classes(spark, classes, text.read_fasta(spark, fasta)).withColumnRenamed("ordinal", "te_tid")
    return te.join(ltr_lengths(te), "te_tid", "left").fillna(0, ["ltr_len"])


def tables(spark: SparkSession, bam_path: str, reference: str, te_fasta: str, te_classes: str, repeats: str = "", gaps: str = "", blacklist: str = "", index: str = "") -> Tables:
    """All input tables; records are parsed once and written to the shared folder, where alignments and sequences are read by column.

    A reference with a .fai beside it is read by ranges, in tiles; any other one contig by contig.
    """
    scratch = Scratch(spark, "files")
    records = bam.read_bam(spark, bam_path, index or None).withColumn("aln_id", alignment_id(F.col("file_offset")))
    records = scratch.cut(records, "records")
    contigs = bam.contigs(spark, bam_path)
    te = scratch.cut(elements(spark, te_fasta, te_classes), "elements")
    named = te.select("name", F.col("te_tid").alias("ordinal"))
    beds = [text.read_bed(spark, path, named if kind == "repeat" else None, kind) for kind, path in (("repeat", repeats), ("gap", gaps), ("blacklist", blacklist)) if path]
    marks = spark.createDataFrame([], "contig string, start int, end int, name string, kind string, rep_tid int")
    for bed in beds:
        marks = marks.unionByName(bed.select(*marks.columns))
    refs, tiles = None, None
    if exists(spark, f"{reference}.fai"):
        lengths = text.read_fai(spark, f"{reference}.fai").withColumnRenamed("length", "_own")
        other = F.raise_error(F.concat(F.lit("reference and alignments differ in the length of "), F.col("name"))).cast("int")
        known = contigs.join(lengths, "name").select("tid", "name", F.when(F.col("_own") != F.col("length"), other).otherwise(F.col("tid")).alias("_tid"))
        tiles = fasta.read_tiles(spark, reference, size=TILE, overlap=4 * FLANK).join(known, "name").select(F.col("_tid").alias("tid"), "tile", "offset", "seq")
        tiles = scratch.cut(tiles, "tiles")
    else:
        refs = scratch.cut(text.read_fasta(spark, reference).join(contigs.select("tid", "name"), "name").select("tid", "name", "seq"), "reference")
    return Tables(
        contigs,
        refs,
        te.select("te_tid", "name", "te_class", "class_bit", "length", "seq", "ltr_len"),
        records.select("aln_id", "qname", "flag", "tid", "pos", "mapq", "cigar", "nm", "nn", "aln_score", "read_len"),
        records.select("aln_id", "qname", "seq"),
        marks,
        tiles,
    )
