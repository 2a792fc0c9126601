"""Running-maximum cover: overlapping alignments of one segment count only what they add."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_cover(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], bin_width=None) -> DataFrame:
    """Adds `counted` (reaches beyond all rows before it) and `added` (the length that it adds).

    With `bin_width`, starts are cut into bins: the greatest end before a row is
    that of its bin or of the bins before (one row each), so that no task sees
    more than one bin of a key.
    """
    if bin_width is None:
        w = Window.partitionBy(*keys).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
        out = df.withColumn("_prev", F.max(end).over(w))
    else:
        cut = df.withColumn("_bin", F.floor(F.col(start) / bin_width))
        w = Window.partitionBy(*keys, "_bin").orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
        b = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = cut.groupBy(*keys, "_bin").agg(F.max(end).alias("_top")).select(*keys, "_bin", F.max("_top").over(b).alias("_before"))
        local = cut.withColumn("_own", F.max(end).over(w)).join(bins, [*keys, "_bin"])
        out = local.withColumn("_prev", F.greatest("_own", "_before")).drop("_bin", "_own", "_before")  # a null is less than anything
    new = F.col("_prev").isNull() | (F.col(end) > F.col("_prev"))
    return out.withColumn("counted", new).withColumn("added", F.when(new, F.col(end) - F.greatest(F.col(start), F.coalesce("_prev", F.col(start)))).otherwise(0)).drop("_prev")


def roll_up(te_alignments: DataFrame) -> DataFrame:
    """seg_id, num_te_aln, sum_query_maplen, sum_aln_score (whole score over mapped length), sum_divergence."""
    c = running_cover(te_alignments, ["seg_id"], "query_start", "query_end", ["aln_score", "query_end", "map_len", "divergence", "te_tid"]).where("counted")
    return c.groupBy("seg_id").agg(F.count(F.lit(1)).cast("int").alias("num_te_aln"), F.sum("added").cast("int").alias("sum_query_maplen"), F.sum(F.try_divide(F.col("aln_score"), F.col("map_len"))).alias("sum_aln_score"), F.sum("divergence").alias("sum_divergence"))
