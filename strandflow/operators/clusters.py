"""Gap clustering and what is rolled up from its clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_cluster(df: DataFrame, keys: list[str], position: str, max_dist, order: list[str], name: str = "idx", bin_width=None) -> DataFrame:
    """Number the runs of rows, by key, whose positions follow each other within `max_dist` (a gap of exactly that merges).

    With `bin_width`, positions are cut into bins first: breaks within bins are
    found bin by bin, the bins' first and last positions (one row each) carry
    breaks and counts across, and no task sees more than one bin of a key.
    """
    if bin_width is None:
        w = Window.partitionBy(*keys).orderBy(position, *order)
        gap = F.col(position) - F.lag(position).over(w)
        return df.withColumn("_break", F.when(gap.isNull() | (gap > max_dist), 1).otherwise(0)).withColumn(name, (F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_break")
    cut = df.withColumn("_bin", F.floor(F.col(position) / bin_width))
    w = Window.partitionBy(*keys, "_bin").orderBy(position, *order)
    gap = F.col(position) - F.lag(position).over(w)
    local = cut.withColumn("_break", F.when(gap > max_dist, 1).otherwise(0)).withColumn("_local", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bins = local.groupBy(*keys, "_bin").agg(F.min(position).alias("_first"), F.max(position).alias("_last"), F.sum("_break").alias("_breaks"))
    b = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.withColumn("_opens", F.when(F.lag("_last").over(b).isNull() | (F.col("_first") - F.lag("_last").over(b) > max_dist), 1).otherwise(0))
    before = F.sum(F.col("_opens")).over(b.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_breaks").over(b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(bins.select(*keys, "_bin", before.alias("_before")), [*keys, "_bin"]).withColumn(name, (F.col("_before") + F.col("_local") - 1).cast("long")).drop("_bin", "_break", "_local", "_before")


def count_of(kind: str, value: int) -> Column:
    return F.count_if(F.col(kind) == value)


def entropy(*counts: Column) -> Column:
    total = sum(counts[1:], counts[0])
    out = F.lit(0.0)
    for c in counts:
        p = c / F.nullif(total, F.lit(0))
        out = out - F.when(c > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    return out


def balance(left: Column, right: Column) -> Column:
    return (F.least(left, right) + 0.01) / (F.greatest(left, right) + 0.01)


def cluster_type(n: Column, n_reads: Column) -> Column:
    """1: one segment; 2: two segments of one read; else 0."""
    return F.when(n == 1, 1).when((n == 2) & (n_reads == 1), 2).otherwise(0)


def modal(position: str) -> Column:
    """The commonest value, the smallest of equals."""
    return F.mode(position, True)


def representative(seg_id: str, is_insertion: Column, read_len: Column, clip_len: Column) -> Column:
    """The insertion with the longest read, else the longest clip; the least id of equals."""
    size = F.when(is_insertion, read_len).otherwise(clip_len)
    return F.max_by(F.col(seg_id), F.struct(is_insertion.cast("int"), size, -F.col(seg_id)))


def frequency(left: Column, middle: Column, right: Column, reference: Column) -> Column:
    own = left + right + 2 * middle
    return own / F.nullif(own + 2 * reference, F.lit(0))


def background(df: DataFrame, group: str, weight: str, divergence: str, length: str, map_len: str) -> DataFrame:
    """One row: mean divergence, exact median length and depth of the group with the greatest weight, the least key of equals."""
    largest = df.groupBy(group).agg(F.max(weight).alias("_w")).agg(F.max_by(F.struct(F.col(group), F.col("_w")), F.struct("_w", -F.col(group))).alias("_g"))
    own = df.join(F.broadcast(largest), F.col(group) == F.col("_g")[group])  # one row
    return own.agg(F.first(F.col("_g")[group]).alias(group), F.avg(divergence).alias("bg_div"), F.median(length).alias("bg_read_len"), (F.sum(map_len) / F.first(F.col("_g")["_w"])).alias("bg_depth"))


def features(segments: DataFrame, keys: list[str], bg_div: float, bg_depth: float, bg_read_len: float) -> DataFrame:
    """All features of a cluster in one aggregation over its segments.

    Means of score and mapped fraction divide by all segments, although only
    those with an element alignment add to them; segments without one add the
    background's divergence.
    """
    n = F.count(F.lit(1))
    te = F.col("num_te_aln") > 0
    per = lambda c: F.try_divide(c, F.col("num_te_aln"))
    frac = lambda k: (F.count_if(F.col("aln_location_type") == k) / n).alias(f"aln_frac_{k}")
    rolled = segments.groupBy(*keys).agg(
        n.alias("num_seg_raw"), (F.min("ref_position") - 1).alias("ref_start"), F.max("ref_position").alias("ref_end"),
        F.count_if(F.col("seg_type") == 1).alias("num_left"), F.count_if(F.col("seg_type") == 2).alias("num_middle"), F.count_if(F.col("seg_type") == 4).alias("num_right"),
        F.bit_count(F.bit_or("seg_type")).alias("num_seg_type"), (F.count_if(te) / n).alias("te_aligned_frac"), F.avg("map_qual").alias("mean_map_qual"),
        (F.count_if(F.col("map_qual") < 5) / n).alias("low_map_qual_frac"), (F.count_if(F.col("aln_type").bitwiseAND(F.lit(5)) == 5) / n).alias("dual_clip_frac"),
        *(frac(k) for k in (1, 2, 4, 8, 16)), (F.coalesce(F.sum(F.when(te, per(F.col("sum_aln_score")))), F.lit(0.0)) / n).alias("mean_aln_score"),
        (F.coalesce(F.sum(F.when(te, F.try_divide(F.col("sum_query_maplen"), F.col("query_end") - F.col("query_start")))), F.lit(0.0)) / n).alias("mean_query_map_frac"),
        (F.sum(F.when(te, per(F.col("sum_divergence"))).otherwise(F.lit(bg_div))) / n / (bg_div or 1.0)).alias("mean_divergence"),
        F.countDistinct("qname").alias("_reads"), modal("ref_position").alias("ref_mode"),
        representative("seg_id", F.col("seg_type") == 2, F.col("read_len"), F.col("query_end") - F.col("query_start")).alias("rep_seg_id"),
    )
    return rolled.withColumns({
        "entropy": entropy(F.col("num_left"), F.col("num_middle"), F.col("num_right")), "balance_ratio": balance(F.col("num_left"), F.col("num_right")),
        "clt_type": cluster_type(F.col("num_seg_raw"), F.col("_reads")), "num_seg": F.col("num_seg_raw") / (bg_depth or 1.0),
        "bg_div": F.lit(bg_div), "bg_depth": F.lit(bg_depth), "bg_read_len": F.lit(bg_read_len),
    }).drop("_reads")


def is_low_quality(blacklisted: Column, probability: Column, ratio: Column) -> Column:
    return blacklisted | (probability <= 0.5) | (ratio >= 10)


def is_low_frequency(clt_type: Column) -> Column:
    """One segment, or two of one read."""
    return clt_type != 0
