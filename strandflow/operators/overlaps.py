"""An overlap graph of the reads of many clusters, and the layout of one contig a cluster.

Reads meet at minimizers that stand once in each of them.  Where some meet, each
is known by how far it reaches to the left and to the right of that place.  One
that another exceeds on both sides is contained in it; all others are in order,
and only neighbours are linked, so that a place costs its reads and not their
pairs, and edges over several reads at once (transitive ones) aren't made.

Clusters of up to GROUP_LETTERS letters are laid out in a group each, so that
reads are shuffled once and their places, which take many times the bytes of the
reads, never; places of larger ones are rows that windows compare.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .minimizers import all_places, minimizer_rows

#: k-mers and windows of minimizers, and letters that an overlap has to have.
K, W, MIN_OVERLAP = 15, 5, 256
#: Reads of a cluster that are compared in one window at first; a larger one is thinned slice by slice.
SLICE_READS = 2_048
BAND = 64
#: Letters of a cluster's reads that are laid out in one group at most.
GROUP_LETTERS = 2_000_000


def places(reads: DataFrame, keys: list[str], k: int = K, w: int = W) -> DataFrame:
    """keys, hash, seg_id, before, after: the minimizers of reads (keys, seg_id, seq), with the read's letters up to each and from it on."""
    m = minimizer_rows(reads, "seq", [*keys, "seg_id"], k, w, once=True)
    return m.select(*keys, "seg_id", "hash", F.col("pos").alias("before"), (F.col("size") - F.col("pos")).alias("after"))


def _dominated(group: list) -> Column:
    """Whether a read that reaches at least as far to the left also reaches as far to the right; of equals the least seg_id stays."""
    return F.coalesce(F.max("after").over(Window.partitionBy(*group).orderBy(F.desc("before"), F.desc("after"), "seg_id").rowsBetween(Window.unboundedPreceding, -1)) >= F.col("after"), F.lit(False))


def contained(at: DataFrame, keys: list[str], edge: Column | int = 1) -> DataFrame:
    """keys, seg_id of the reads that others exceed on both sides at `edge` places or more.

    Containment is an order (by length, then seg_id), so that never all of a
    cluster are contained.  Slices are thinned first: what is contained in a
    slice is contained in all.
    """
    n = at.groupBy(*keys).agg(F.approx_count_distinct("seg_id").alias("_reads"))
    some = at.join(n, keys).withColumn("_slice", F.pmod(F.xxhash64("seg_id"), F.ceil(F.col("_reads") / SLICE_READS)))
    first = some.withColumn("_in", _dominated([*keys, "hash", "_slice"]))
    rest = first.where(~F.col("_in")).withColumn("_in", _dominated([*keys, "hash"]))
    hit = first.where("_in").select(*keys, "seg_id").unionByName(rest.where("_in").select(*keys, "seg_id"))
    return hit.groupBy(*keys, "seg_id").agg(F.count(F.lit(1)).alias("_places")).where(F.col("_places") >= edge).select(*keys, "seg_id")


def links(at: DataFrame, keys: list[str], min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """keys, a, b, n, shift, a_pos, b_pos: read b begins `shift` letters behind a, at n places; (a_pos, b_pos) is the one deepest in their overlap.

    Rows of `at` are of reads that aren't contained.  Of the shifts of two reads
    the band that most places agree on counts.
    """
    by = Window.partitionBy(*keys, "hash").orderBy(F.desc("before"), "after", "seg_id")
    near = at.select(*keys, F.col("seg_id").alias("a"), F.lead("seg_id").over(by).alias("b"), F.col("before").alias("a_pos"), F.lead("before").over(by).alias("b_pos"), F.col("after").alias("_rest"))
    near = near.where(F.col("b").isNotNull() & (F.col("b_pos") + F.col("_rest") >= min_overlap)).withColumn("shift", F.col("a_pos") - F.col("b_pos"))
    deep = F.max_by(F.struct("shift", "a_pos", "b_pos"), F.struct(F.least("b_pos", "_rest"), "a_pos"))
    banded = near.groupBy(*keys, "a", "b", F.floor(F.col("shift") / BAND).alias("_band")).agg(F.count(F.lit(1)).alias("n"), deep.alias("_at"))
    best = F.max_by(F.struct("n", "_at"), F.struct("n", -F.col("_band"))).alias("_x")
    return banded.groupBy(*keys, "a", "b").agg(best).select(*keys, "a", "b", "_x.n", "_x._at.*")


def longest_path(edges: list[tuple], sizes: dict, least: int) -> list[tuple]:
    """[(read, start, end)] of the unitig with most letters, over edges (a, b, n, a_pos, b_pos) with n of at least `least`.

    An edge counts where it is the best one out of a and the best one into b, so
    that each read has at most one neighbour on a side.  A circle is opened at
    its least read.
    """
    out, into = {}, {}
    for a, b, n, a_pos, b_pos in edges:
        if n >= least:
            rank = (-n, a_pos - b_pos, a, b)
            out[a] = min(out.get(a, (rank, a, b, a_pos, b_pos)), (rank, a, b, a_pos, b_pos))
            into[b] = min(into.get(b, (rank, a, b, a_pos, b_pos)), (rank, a, b, a_pos, b_pos))
    after = {a: x for a, x in out.items() if into[x[2]][1] == a}
    heads = [r for r in sizes if not (r in into and after.get(into[r][1], (None, None, None))[2] == r)]
    best, seen = (0, None, []), set()
    for head in [*sorted(heads), *sorted(sizes)]:
        if head in seen:
            continue
        path, read, start = [], head, 0
        while True:
            seen.add(read)
            step = after.get(read)
            if step is None or step[2] in seen:
                path.append((read, start, sizes[read]))
                break
            _, _, nxt, a_pos, b_pos = step
            path.append((read, start, max(a_pos, start)))
            start, read = b_pos + max(start - a_pos, 0), nxt
        letters = sum(e - s for _, s, e in path)
        if best[1] is None or letters > best[0]:
            best = (letters, head, path)
    return best[2]


def chosen_path(edges: list[tuple], sizes: dict, edge: int, any_inside: bool) -> list[tuple]:
    """The longest path at `edge` places, or else at fewer; empty where no two reads overlap."""
    path: list[tuple] = []
    for least in range(edge, 0, -1):
        path = longest_path(edges, sizes, least)
        if len(path) > 1:
            break
    return path if len(path) > 1 or any_inside else []


def lay_out(names: list, seqs: list[str], edge: int, k: int, w: int, min_overlap: int) -> tuple[str, int] | None:
    """(contig, reads of its path) of one cluster's reads in order of their names, as `contained` and `links` say it for all; None without an overlap."""
    of, before, h = all_places(seqs, k, w)
    after = np.array([len(s) for s in seqs], np.int64)[of] - before

    def ordered(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((*by[::-1], h))
        return order, np.flatnonzero(np.diff(h[order]) == 0) + 1  # and the rows that aren't the first of their place

    order, later = ordered(-before, -after, of)
    group = np.zeros(len(h), np.int64)
    group[later] = 1
    group = np.cumsum(1 - group)
    reach = after[order] + group * (1 << 32)
    top = np.maximum.accumulate(reach)
    inside = np.zeros(len(seqs), bool)
    inside[of[order[later[top[later - 1] >= reach[later]]]]] = True
    keep = ~inside[of]
    of, before, after, h = of[keep], before[keep], after[keep], h[keep]
    order, later = ordered(-before, after, of)
    a, b = order[later - 1], order[later]
    far = before[b] + after[a] >= min_overlap
    a, b = a[far], b[far]
    shift, deep = before[a] - before[b], np.minimum(before[b], after[a])
    band = shift // BAND
    # of a band's places the deepest comes last, of a pair's bands that of most places
    order = np.lexsort((before[b], before[a], deep, band, of[b], of[a]))
    cols = np.stack([of[a], of[b], band, before[a], before[b]])[:, order]
    last = np.flatnonzero(np.append((np.diff(cols[:3]) != 0).any(axis=0), True)) if len(order) else order
    n = np.diff(last, prepend=-1)
    found: dict[tuple[int, int], tuple] = {}
    for x, y, z, p, q, m in zip(*cols[:, last].tolist(), n.tolist(), strict=True):
        found[x, y] = max(found.get((x, y), (0, 0, 0, 0)), (m, -z, p, q))
    sizes = {str(names[r]): len(seqs[r]) for r in np.unique(of).tolist()}
    path = chosen_path([(str(names[x]), str(names[y]), m, p, q) for (x, y), (m, _, p, q) in found.items()], sizes, edge, bool(inside.any()))
    text = {str(name): seq for name, seq in zip(names, seqs, strict=True)}
    return ("".join(text[r][s:e] for r, s, e in path), len(path)) if path else None


def layout(reads: DataFrame, keys: list[str], edge: DataFrame | int, scratch, k: int = K, w: int = W, min_overlap: int = MIN_OVERLAP, letters: DataFrame | None = None) -> DataFrame:
    """keys, laid, n_reads: the longest contig of each cluster whose reads (keys, seg_id, seq) overlap; clusters without an overlap are left out.

    `letters` (keys, _letters) has the letters of each cluster's reads or more,
    where that is known without a pass over the reads.  `edge`, one number or (keys, edge), says at how many places two reads have to
    meet.  Where that leaves no path, fewer are tried, down to one.
    """
    fields = {f.name: f.dataType.simpleString() for f in reads.schema}
    reads = reads.where(F.length("seq") >= min_overlap)  # a shorter read overlaps none
    if letters is None:
        letters = reads.groupBy(*keys).agg(F.sum(F.length("seq")).alias("_letters"))
    large = scratch.cut(letters.where(F.col("_letters") > GROUP_LETTERS).select(*keys), "large")
    asked = (lambda df: df.withColumn("edge", F.lit(edge))) if isinstance(edge, int) else lambda df: df.join(edge, keys)
    some = not large.isEmpty()

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg_id")
        laid = lay_out(t.column("seg_id").to_pylist(), t.column("seq").to_pylist(), t.column("edge")[0].as_py(), k, w, min_overlap)
        head = t.select(keys).slice(0, 1 if laid else 0)
        return pa.Table.from_arrays([*head.columns, pa.array([laid[0]] if laid else [], pa.string()), pa.array([laid[1]] if laid else [], pa.int32())], names=[*keys, "laid", "n_reads"])

    small = asked(reads.join(large, keys, "left_anti") if some else reads).select(*keys, "seg_id", "seq", "edge")
    laid = small.groupBy(*keys).applyInArrow(group, ", ".join(f"{c} {fields[c]}" for c in keys) + ", laid string, n_reads int")
    if not some:
        return laid
    edges = asked(large).select(*keys, "edge")
    return laid.unionByName(_layout_by_places(reads.join(large, keys, "left_semi"), keys, edges, scratch, k, w, min_overlap))


def _layout_by_places(reads: DataFrame, keys: list[str], edge: DataFrame, scratch, k: int, w: int, min_overlap: int) -> DataFrame:
    """The same for clusters of any size; a group of the last step holds numbers of the reads that aren't contained, which begin at different letters, and texts are only joined to the chosen path."""
    fields = {f.name: f.dataType.simpleString() for f in reads.schema}
    at = scratch.cut(places(reads, keys, k, w), "places")
    inside = scratch.cut(contained(at.join(edge, keys), keys, 1), "contained")
    outer = at.join(inside, [*keys, "seg_id"], "left_anti")
    edges = links(outer, keys, min_overlap)
    ends = outer.groupBy(*keys, "seg_id").agg(F.max(F.col("before") + F.col("after")).alias("_size"))
    many = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_inside"))
    text = lambda c: F.col(c).cast("string")  # noqa: E731  a number beside nulls would lose digits in pandas
    nodes = ends.select(*keys, text("seg_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("_size").cast("long").alias("n"), F.lit(0).alias("a_pos"), F.lit(0).alias("b_pos"))
    rows = nodes.unionByName(edges.select(*keys, text("a").alias("a"), text("b").alias("b"), "n", "a_pos", "b_pos")).join(edge, keys).join(many, keys, "left")

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        is_node = pdf["b"].isna()
        sizes = {r.a: int(r.n) for r in pdf[is_node].itertuples()}
        found = [(r.a, r.b, int(r.n), int(r.a_pos), int(r.b_pos)) for r in pdf[~is_node].itertuples()]
        path = chosen_path(found, sizes, int(pdf["edge"].iloc[0]), not pdf["_inside"].isna().iloc[0])
        return pd.DataFrame([(i, *x) for i, x in enumerate(path)], columns=["_order", "seg_id", "_start", "_end"]).assign(**{c: pdf[c].iloc[0] for c in keys})[[*keys, "_order", "seg_id", "_start", "_end"]]

    head = ", ".join(f"{c} {fields[c]}" for c in keys)
    # few bytes and much work: a number of partitions of its own, which isn't made smaller for its bytes
    rows = rows.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    paths = rows.groupBy(*keys).applyInPandas(lay, f"{head}, _order int, seg_id string, _start int, _end int").withColumn("seg_id", F.col("seg_id").cast(fields["seg_id"]))
    piece = F.struct("_order", F.expr("substring(seq, _start + 1, _end - _start)").alias("_text"))
    laid = paths.join(reads.select(*keys, "seg_id", "seq"), [*keys, "seg_id"]).groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    return laid.select(*keys, F.array_join(F.transform("_pieces", lambda x: x["_text"]), "").alias("laid"), F.size("_pieces").alias("n_reads"))
