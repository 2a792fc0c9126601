"""Text sources: FASTA, FASTA index, BED, element classes; and the TSV and FASTA sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags
from ..operators import merge

#: The columns of the result table.
RESULT = (
    "chrom", "start", "end", "family", "frequency", "strand", "genotype", "passed", "query_region", "target_region", "total_support", "tsd_seq", "insertion_seq",
    "upstream_seq", "downstream_seq", "extra_info",
)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, length, ordinal: one row for each record, cut at its header by the line separator, not by a driver loop."""
    raw = spark.read.option("lineSep", ">").text(path).select(F.col("value"), F.monotonically_increasing_id().alias("_at")).where("length(trim(value)) > 0")
    parts = F.split("value", "\r?\n", 2)
    rows = raw.select("_at", F.regexp_extract(parts[0], r"^(\S+)", 1).alias("name"), F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")).alias("seq"))
    # ordinals follow the file: ids grow with split and line; counts by split give each its offset
    rows = rows.withColumn("_split", F.shiftright("_at", 33))
    counts = rows.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a file split
    rank = F.row_number().over(Window.partitionBy("_split").orderBy("_at"))
    return rows.withColumn("_r", rank).join(before, "_split").select((F.col("_before") + F.col("_r") - 1).cast("int").alias("ordinal"), "name", "seq", F.length("seq").alias("length"))


def tiles(refs: DataFrame, size: int = 65_536, overlap: int = 2_000, key: str = "name") -> DataFrame:
    """Contigs in overlapping tiles (key, tile, offset, seq), so that a region is fetched without its whole contig.

    A contig is cut once from front to end, in batches of some tiles; an indexed
    file is better read by `fasta.read_tiles`, for which no row holds a contig.
    """
    kind = refs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                seq = batch.column(1)[row].as_py()
                if seq is None:
                    continue
                for lo in range(0, max(len(seq), 1), 64 * size):
                    at = range(lo, min(lo + 64 * size, max(len(seq), 1)), size)
                    cols = [pa.array([batch.column(0)[row].as_py()] * len(at), batch.schema.field(0).type), pa.array([x // size for x in at], pa.int32()), pa.array(list(at), pa.int32()), pa.array([seq[x : x + size + overlap] for x in at], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, [key, "tile", "offset", "seq"])

    return refs.select(key, F.col("seq").cast("string")).mapInArrow(run, f"`{key}` {kind}, tile int, offset int, seq string")


def fasta_index(refs: DataFrame, *more: str) -> DataFrame:
    return refs.select("ordinal", "name", "length", *more)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """name, length of the contigs of a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="name string, length int, offset long, line_bases int, line_width int").select("name", "length")


def read_bed(spark: SparkSession, path: str, te: DataFrame | None = None, kind: str = "repeat") -> DataFrame:
    """contig, start, end, name, kind, rep_tid: rows with start > end go; the fourth field has to be there; unknown names have -1."""
    raw = spark.read.csv(path, sep="\t", schema="contig string, start int, end int, name string", comment="#").where("start <= end")
    checked = raw.withColumn("name", F.coalesce("name", F.raise_error(F.concat(F.lit("a BED line has no name: "), F.col("contig")))))
    out = checked.withColumn("kind", F.lit(kind))
    if te is None:
        return out.withColumn("rep_tid", F.lit(-1))
    return merge.looked_up(out, ["name"], te.select("name", F.col("ordinal").alias("rep_tid")), "rep_tid", -1)


def read_classes(spark: SparkSession, path: str, te: DataFrame) -> DataFrame:
    """The element table with class and class bit, joined by name; an element without a class line raises."""
    words = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).select(words.alias("w")).where(F.size("w") >= 2).select(F.col("w")[0].alias("name"), F.col("w")[1].alias("te_class")).dropDuplicates(["name"])
    joined = te.join(raw, "name", "left")
    return joined.withColumn("te_class", F.coalesce("te_class", F.raise_error(F.concat(F.lit("no class for element "), F.col("name"))))).withColumn("class_bit", flags.class_bit(F.col("te_class")))


def write_result(df: DataFrame, path: str) -> None:
    """The result table as tab-separated text with a header line, in the order of insertion_id as text, dealt by ranges."""
    rows = merge.sorted_rows(df, ["insertion_id"]) if "insertion_id" in df.columns else df
    rows.select(*RESULT).write.csv(path, sep="\t", header=True, emptyValue="")


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq))).write.text(path)
