"""Interval joins by ranges: co-grouped stretches of a key, probed by binary search.

A predicate of ranges alone makes Spark compare every pair.  Here a sample of
positions cuts each key into stretches of about as many rows; a query and an
interval are dealt to the stretches that they touch, which for nearly all is one
row, however long they are.  Equal positions can't be cut: the queries of such a
place are dealt to several groups, each with a copy of the intervals.  In a
group, intervals are decomposed into lists in which none contains another, so
that starts and ends both ascend: what a query overlaps is then one slice of
each list, and counts and nearest edges need no list of pairs.  For these, equal
intervals are one with a weight (each would open a list of its own, which all
queries probe), and queries of one place are one.

A pair belongs to the stretch of the later of its two starts.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import Scratch

#: Rows of a stretch, about, and sampled rows that stand for one.
RANGE_ROWS, SAMPLE = 100_000, 32
_LEAST = -(1 << 62)


def _stretches(queries: DataFrame, intervals: DataFrame, key: str) -> DataFrame | None:
    """key, _starts, _copies, _steps: where the stretches of a key begin after its first one, into how many groups each is dealt, and the depth of a search among them.

    None where all is one stretch a key.  There are at most as many starts as
    rows / RANGE_ROWS, so that they are broadcast.
    """
    at = queries.select(F.col(key), F.col("_lo").alias("_at")).unionByName(intervals.select(F.col(key), F.col("_s").alias("_at")))
    n = at.count()
    parts = -(-n // RANGE_ROWS)
    if parts < 2:
        return None
    some = at.where(F.rand(7) < min(1.0, SAMPLE * parts / n)).groupBy(key).agg(F.sort_array(F.collect_list("_at")).alias("_at")).where(F.size("_at") > SAMPLE)
    kind = at.schema[key].dataType.simpleString()

    def cut(batches):
        for pdf in batches:
            rows = []
            for x in pdf["_at"]:
                starts, copies = np.unique(np.asarray(x, np.int64)[SAMPLE::SAMPLE], return_counts=True)
                rows.append((starts, np.concatenate([[1], copies]), len(starts).bit_length() + 1))
            yield pd.DataFrame({key: pdf[key], "_starts": [r[0] for r in rows], "_copies": [r[1] for r in rows], "_steps": [r[2] for r in rows]})

    out = some.mapInPandas(cut, f"`{key}` {kind}, _starts array<long>, _copies array<long>, _steps int")
    # a sample is drawn once: both sides have to see the same stretches
    return F.broadcast(Scratch(queries.sparkSession, "stretches").cut(out, "starts", parts))


def _stretch(x: Column) -> Column:
    """How many starts of the key are not above x, by binary search."""
    half = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    step = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get("_starts", half(a)) <= x, pair(half(a) + 1, a["hi"])).otherwise(pair(a["lo"], half(a)))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.col("_steps")), pair(F.lit(0), F.size("_starts")), step, lambda a: a["lo"]), F.lit(0))


def _dealt(queries: DataFrame, intervals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Queries (key, _lo, _hi, ...) and intervals (key, _s, _e, ...) with their group (_part, _copy), and for queries the least start that counts there."""
    scratch = Scratch(queries.sparkSession, "ranges")
    q, i = scratch.cut(queries.where(F.col(key).isNotNull() & F.col("_lo").isNotNull() & F.col("_hi").isNotNull()), "queries"), scratch.cut(intervals.where(F.col(key).isNotNull() & F.col("_s").isNotNull() & F.col("_e").isNotNull()), "intervals")
    starts = _stretches(q, i, key)
    if starts is None:
        zero = F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_copy")
        return q.select("*", *zero, F.lit(_LEAST).alias("_from")), i.select("*", *zero)
    q, i = q.join(starts, key, "left"), i.join(starts, key, "left")
    touched = lambda lo, hi: F.sequence(_stretch(lo), F.greatest(_stretch(lo), _stretch(hi - 1)))
    copies = F.coalesce(F.get("_copies", F.col("_part")), F.lit(1).cast("long"))
    own = [f.name for f in queries.schema.fields if "map<" not in f.dataType.simpleString()]
    q = q.withColumn("_home", _stretch(F.col("_lo"))).withColumn("_part", F.explode(touched(F.col("_lo"), F.col("_hi"))))
    q = q.withColumns({"_from": F.when(F.col("_part") == F.col("_home"), _LEAST).otherwise(F.get("_starts", F.col("_part") - 1)), "_copy": F.pmod(F.xxhash64(*own), copies)})
    i = i.withColumn("_part", F.explode(touched(F.col("_s"), F.col("_e")))).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    drop = ("_starts", "_copies", "_steps", "_home")
    return q.drop(*drop), i.drop(*drop)


class Lists:
    """Intervals in lists in which starts and ends both ascend; each list is (starts, ends, places in the input)."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        order = np.lexsort((-ends, starts))
        tails: list[int] = []  # minus the last end of each list, ascending: an interval joins the list whose last end is the greatest below its own
        of = np.zeros(len(order), np.int64)
        for x, e in enumerate(ends[order].tolist()):
            k = bisect_left(tails, -e + 1)
            if k == len(tails):
                tails.append(-e)
            tails[k], of[x] = -e, k
        self.lists = []
        by_list = np.argsort(of, kind="stable")
        for part in np.split(by_list, np.flatnonzero(np.diff(of[by_list])) + 1) if len(order) else []:
            at = order[part]
            self.lists.append((starts[at], ends[at], at))

    def slices(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray):
        """For each list what queries overlap: intervals with start < hi, end > lo and start >= least, as first places and ends."""
        for starts, ends, at in self.lists:
            first = np.maximum(np.searchsorted(ends, lo, "right"), np.searchsorted(starts, least, "left"))
            yield starts, ends, at, first, np.maximum(np.searchsorted(starts, hi, "left"), first)


def _nearest(values: np.ndarray, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distance of x to the nearest of values[first:end], which ascend and aren't empty."""
    at = np.searchsorted(values, x)
    return np.minimum(np.abs(values[np.clip(at, first, end - 1)] - x), np.abs(values[np.clip(at - 1, first, end - 1)] - x))


def _longs(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).cast(pa.int64()).to_numpy()


def _low(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0))).cast("long")


def _cogrouped(queries: DataFrame, intervals: DataFrame, key: str, run, schema: str) -> DataFrame:
    q, i = _dealt(queries, intervals, key)
    return q.groupBy(key, "_part", "_copy").cogroup(i.groupBy(key, "_part", "_copy")).applyInArrow(run, schema)


def overlap_pairs(queries: DataFrame, intervals: DataFrame, key: str, slack, width=None, q=("start", "end"), i=("i_start", "i_end")) -> DataFrame:
    """All pairs with i_start < end + slack and i_end > start - slack of one key; both sides' columns, which must differ but for the key.

    Positions are whole numbers.  `width` has no use any more: stretches follow
    the data.  Null keys and bounds have no pairs.
    """
    left = queries.withColumns({"_lo": _low(F.col(q[0]) - slack), "_hi": (F.col(q[1]) + slack).cast("long")})
    right = intervals.withColumns({"_s": F.col(i[0]).cast("long"), "_e": F.col(i[1]).cast("long")})
    own, theirs = queries.columns, [c for c in intervals.columns if c != key]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        lo, hi, least = (_longs(a, c) for c in ("_lo", "_hi", "_from"))
        mine, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, at, first, end in Lists(_longs(b, "_s"), _longs(b, "_e")).slices(lo, hi, least):
            n = end - first
            mine.append(np.repeat(np.arange(len(lo)), n))
            others.append(at[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        x, y = a.select(own).take(np.concatenate(mine)), b.select(theirs).take(np.concatenate(others))
        return pa.Table.from_arrays([*x.columns, *y.columns], names=[*own, *theirs])

    kinds = [(f.name, f.dataType.simpleString()) for f in [*queries.schema, *(intervals.schema[c] for c in theirs)]]
    return _cogrouped(left, right, key, run, ", ".join(f"`{c}` {t}" for c, t in kinds))


def _summed(queries: DataFrame, intervals: DataFrame, key: str, edges: list[str], rep: str | None) -> tuple[DataFrame, list[str]]:
    """(a row for each place of the queries that overlaps something, with n, min_dist over all pairs of the `edges` and the intervals', and `rep`; the columns of a place).

    Queries of one place have one result, and equal intervals differ by `rep`
    alone: each is one row of the join, which so follows the number of places.
    """
    place = [key, "_lo", "_hi", *edges]
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    rep_kind = intervals.schema[rep].dataType.simpleString() if rep else None
    left = queries.select(*place).distinct()
    right = intervals.groupBy(key, "_s", "_e").agg(F.count(F.lit(1)).alias("_n"), *([F.min(rep).alias(rep)] if rep else []))
    far = np.int64(1 << 62)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        lo, hi, least = (_longs(a, c) for c in ("_lo", "_hi", "_from"))
        at_edges = [_longs(a, c) for c in edges]
        many, value = _longs(b, "_n"), _longs(b, rep) if rep else np.zeros(len(b), np.int64)
        count, dist = np.zeros(len(lo), np.int64), np.full(len(lo), far)
        best = [np.full(len(lo), -far), np.full(len(lo), -far), np.full(len(lo), -far)]  # start, end, -rep of the greatest
        for starts, ends, at, first, end in Lists(_longs(b, "_s"), _longs(b, "_e")).slices(lo, hi, least):
            hit = np.flatnonzero(end > first)
            f, e = first[hit], end[hit]
            before = np.concatenate([[0], np.cumsum(many[at])])
            count[hit] += before[e] - before[f]
            for x in at_edges:
                dist[hit] = np.minimum(dist[hit], np.minimum(_nearest(starts, x[hit], f, e), _nearest(ends, x[hit], f, e)))
            new = (starts[e - 1], ends[e - 1], -value[at[e - 1]])
            over = (new[0] > best[0][hit]) | (new[0] == best[0][hit]) & ((new[1] > best[1][hit]) | (new[1] == best[1][hit]) & (new[2] > best[2][hit]))
            for k in range(3):
                best[k][hit[over]] = new[k][over]
        keep = pa.array(np.flatnonzero(count))
        out = a.select(place).take(keep)
        cols = [pa.array(x).take(keep) for x in (count, dist, *best)]
        return pa.Table.from_arrays([*out.columns, *cols], names=[*place, "n", "min_dist", "_bs", "_be", "_br"])

    parts = _cogrouped(left, right, key, run, ", ".join(f"`{c}` {kinds[c]}" for c in place) + ", n long, min_dist long, _bs long, _be long, _br long")
    # a query that spans stretches has a row in each
    found = parts.groupBy(*place).agg(F.sum("n").alias("n"), F.min("min_dist").alias("min_dist"), *([(-F.max_by("_br", F.struct("_bs", "_be", "_br"))).cast(rep_kind).alias(rep)] if rep else []))
    return found, place


def _kept(queries: DataFrame) -> DataFrame:
    """The queries as a table, since they are read for their places and for their results."""
    return Scratch(queries.sparkSession, "queries").cut(queries, "all")


def point_overlaps(points: DataFrame, intervals: DataFrame, key: str, point: str, ids: list[str], slack, width=None, i=("i_start", "i_end")) -> DataFrame:
    """ids, n (intervals within `slack` of the point) and min_dist (to the nearest of their edges); points without any have 0 and null."""
    p = F.col(point)
    left = _kept(points.select(*dict.fromkeys([key, point, *ids]))).withColumns({"_at": p.cast("long"), "_lo": _low(p - slack), "_hi": (p + slack).cast("long")})
    right = intervals.withColumns({"_s": F.col(i[0]).cast("long"), "_e": F.col(i[1]).cast("long")})
    found, place = _summed(left, right, key, ["_at"], None)
    return left.select(*dict.fromkeys([*place, *ids])).join(found, place, "left").select(*ids, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "min_dist")


def interval_overlaps(queries: DataFrame, intervals: DataFrame, key: str, ids: list[str], slack, width, rep: str, q=("start", "end"), i=("i_start", "i_end")) -> DataFrame:
    """ids, n, min_dist over all four pairs of edges, and `rep` of the interval with the greatest start, then end, then the least rep (a whole number)."""
    edges = {"_qs": F.col(q[0]).cast("long"), "_qe": F.col(q[1]).cast("long"), "_lo": _low(F.col(q[0]) - slack), "_hi": (F.col(q[1]) + slack).cast("long")}
    left = _kept(queries.select(*dict.fromkeys([key, *q, *ids]))).withColumns(edges)
    right = intervals.withColumns({"_s": F.col(i[0]).cast("long"), "_e": F.col(i[1]).cast("long")})
    found, place = _summed(left, right, key, ["_qs", "_qe"], rep)
    return left.select(*dict.fromkeys([*place, *ids])).join(found.withColumnRenamed(rep, "_rep"), place, "left").select(*ids, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "min_dist", F.col("_rep").alias(rep))


def location_type(n: Column, min_dist: Column, near: int = 50) -> Column:
    """1: nothing there; 2: near an edge; 4: inside."""
    return F.when(n == 0, 1).when(min_dist < near, 2).otherwise(4)


def alignment_location(start_type: Column, end_type: Column) -> Column:
    both = start_type.bitwiseOR(end_type)
    return F.when(both.isin(1, 5), 1).when(both == 4, 2).when(both == 2, 4).when(both == 3, 8).when(both == 6, 16).otherwise(0)


def semi(queries: DataFrame, intervals: DataFrame, key: str, ids: list[str], slack, width=None, how: str = "left_semi", q=("start", "end"), i=("i_start", "i_end")) -> DataFrame:
    """The queries that some interval overlaps within `slack`, or with how="left_anti" the others."""
    left = _kept(queries).withColumns({"_lo": _low(F.col(q[0]) - slack), "_hi": (F.col(q[1]) + slack).cast("long")})
    right = intervals.withColumns({"_s": F.col(i[0]).cast("long"), "_e": F.col(i[1]).cast("long")})
    found, place = _summed(left, right, key, [], None)
    return left.join(found.select(*place), place, how).select(*queries.columns)


def spanning(breakpoints: DataFrame, reads: DataFrame, supporters: DataFrame, key: str, cluster: list[str], read: str, margin, width=None, at=("ref_start", "ref_end")) -> DataFrame:
    """cluster, n_ref: reads (i_start, i_end) that reach beyond both sides of the breakpoint by `margin` and don't support the cluster."""
    lo, hi = F.col(at[0]) - margin, F.col(at[0]) + margin
    b = breakpoints.select(key, *cluster, lo.cast("long").alias("_from_at"), hi.cast("long").alias("_to_at"))
    near = overlap_pairs(b, reads.select(key, read, "i_start", "i_end"), key, 0, q=("_from_at", "_to_at"))
    near = near.where((F.col("i_start") < F.col("_from_at")) & (F.col("i_end") > F.col("_to_at"))).select(*cluster, read)
    other = near.join(supporters.select(*cluster, read), [*cluster, read], "left_anti")
    n = other.groupBy(*cluster).agg(F.countDistinct(read).alias("n_ref"))
    return breakpoints.select(*cluster).join(n, cluster, "left").withColumn("n_ref", F.coalesce("n_ref", F.lit(0).cast("long")))
