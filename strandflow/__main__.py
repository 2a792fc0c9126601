"""Command line: `python -m strandflow` finds insertions in a BAM file and writes the result as tab-separated text."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scoring
from .plans import caller, files
from .sources import text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandflow", description="Insertions of transposable elements from long-read alignments.")
    defaults = caller.CallerConfig()
    for short, name, what in (("-b", "bam", "alignments, sorted by place"), ("-C", "class", "class of each element, by name"), ("-T", "te_fn", "FASTA of elements"), ("-R", "ref_fa", "FASTA of the reference")):
        p.add_argument(short, f"--{name}", required=True, help=what)
    for short, name, what in (("-r", "repeat", "BED of repeats"), ("-g", "gap", "BED of gaps"), ("-B", "blacklist", "BED of places to leave out"), ("-i", "index", ".bai of the alignments, by which the file is read in parts"),
                              ("-H", "high", "JSON model for clusters of several reads"), ("-L", "low", "JSON model for the rest")):
        p.add_argument(short, f"--{name}", default="", help=what)
    for short, name, what in (("-e", "min_edge", "reads that have to share an edit, 0: by their number"), ("-n", "node_len", "shortest assembly, a multiple of 256"), ("-l", "min_seg_len", "shortest clip or insertion"),
                              ("-d", "max_dist", "largest gap within a cluster"), ("-O", "overhang", "fewest bases aligned beside a segment")):
        p.add_argument(short, f"--{name}", type=int, default=getattr(defaults, name), help=what)
    p.add_argument("-o", "--outpath", default="./", help="folder of the result")
    p.add_argument("-t", "--num_thread", type=int, default=1, help="threads, where no cluster is configured")
    return p


def config(args: argparse.Namespace) -> caller.CallerConfig:
    """The options as the caller takes them; what makes no sense raises ValueError."""
    if args.min_edge < 0 or min(args.node_len, args.min_seg_len, args.max_dist, args.overhang) <= 0:
        raise ValueError("min_edge must not be negative; node_len, min_seg_len, max_dist and overhang have to be positive")
    return caller.CallerConfig(min_seg_len=args.min_seg_len, max_dist=args.max_dist, overhang=args.overhang, min_edge=args.min_edge, node_len=args.node_len)


def check_files(spark: SparkSession, args: argparse.Namespace) -> None:
    """FileNotFoundError for a file that was named and isn't there, on whatever file system."""
    for name in ("bam", "class", "te_fn", "ref_fa", "repeat", "gap", "blacklist", "index", "high", "low"):
        if (path := getattr(args, name)) and not files.exists(spark, path):
            raise FileNotFoundError(path)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    cfg = config(args)
    builder = SparkSession.builder.appName("strandflow")
    if "PYSPARK_GATEWAY_PORT" not in os.environ and SparkSession.getActiveSession() is None:  # spark-submit names its own master
        builder = builder.master(f"local[{args.num_thread}]")
    spark = builder.getOrCreate()
    check_files(spark, args)
    t = files.tables(spark, args.bam, args.ref_fa, args.te_fn, getattr(args, "class"), args.repeat, args.gap, args.blacklist, args.index)
    high, low = (scoring.load(path) if path else None for path in (args.high, args.low))
    result = caller.cut(caller.call(t, cfg, high, low), "result")
    text.write_result(result, f"{args.outpath.rstrip('/')}/result")
    row = result.agg(F.count(F.lit(1)).alias("insertions"), F.count_if("passed").alias("passed")).first()
    print(f"{row['insertions']} insertions, {row['passed']} of them pass; {args.outpath.rstrip('/')}/result")


if __name__ == "__main__":
    main()
