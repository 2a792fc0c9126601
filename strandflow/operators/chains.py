"""Collinear chains of anchors, and alignments along them.

A chain takes anchors that follow each other in the query and in the target.
Each counts `weight`, and each letter between two of them, on either side,
costs `cost`: so the best way to an anchor is a maximum over all that lie before
it in both, which a Fenwick tree over the target's places gives in the order of
the query's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .banded import LONG_GAP, align_batch
from .minimizers import anchors

WEIGHT, COST = 64, 1
#: An anchor's record: score, anchors so far, and where its chain begins (query, target); of equal scores the greater record counts.
_NOTHING = (0, 0, -1, -1)


def best_chains(q: np.ndarray, t: np.ndarray, weight: int = WEIGHT, cost: int = COST) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(record, anchor before or -1) of each anchor; anchors are sorted by q, then t."""
    places = np.unique(t)
    rank = np.searchsorted(places, t) + 1
    tree: list[tuple] = [((-1 << 62,), -1)] * (len(places) + 1)
    records: list[tuple[int, int, int, int]] = []
    before = np.full(len(q), -1, np.int64)
    qs, ts, ranks = q.tolist(), t.tolist(), rank.tolist()
    lo = 0
    while lo < len(qs):
        hi = lo
        while hi < len(qs) and qs[hi] == qs[lo]:
            hi += 1
        for i in range(lo, hi):  # what has the same place in the query isn't before it
            top, r = tree[0], ranks[i] - 1
            while r > 0:
                top = max(top, tree[r])
                r -= r & -r
            gain = top[0][0] - cost * (qs[i] + ts[i]) if top[1] >= 0 else -1
            if gain > 0:
                before[i] = top[1]
                records.append((weight + gain, top[0][1] + 1, top[0][2], top[0][3]))
            else:
                records.append((weight, 1, qs[i], ts[i]))
        for i in range(lo, hi):
            score, n, q0, t0 = records[i]
            key = ((score + cost * (qs[i] + ts[i]), n, q0, t0), i)
            r = ranks[i]
            while r < len(tree):
                tree[r] = max(tree[r], key)
                r += r & -r
        lo = hi
    return records, before


def disjoint(q: np.ndarray, t: np.ndarray, least: int, weight: int = WEIGHT, cost: int = COST) -> list[tuple[int, list[int]]]:
    """(score, anchors in order) of chains that share no anchor, the best first; one that runs into an earlier one ends there."""
    records, before = best_chains(q, t, weight, cost)
    used = np.zeros(len(q), bool)
    out = []
    for i in sorted(range(len(q)), key=lambda i: (records[i], i), reverse=True):
        if used[i] or records[i][0] < least:
            continue
        path, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = before[at]
        # a chain that ends in another one doesn't have what that one had
        score = records[i][0] - (records[at][0] - cost * (q[path[-1]] - q[at] + t[path[-1]] - t[at]) if at >= 0 else 0)
        if score >= least:
            out.append((int(score), path[::-1]))
    return sorted(out, key=lambda x: -x[0])


CHAIN = "score long, n_anchors long, q_lo long, q_hi long, t_lo long, t_hi long"


def chains(found: DataFrame, keys: list[str], min_anchors: int = 1, least: int = 0, weight: int = WEIGHT, cost: int = COST, all_chains: bool = True) -> DataFrame:
    """keys, CHAIN, low, high (least and greatest q - t): the chains of anchors (keys, q_pos, t_pos), or the best by key alone.

    Repeated anchors count once.  Keys with fewer than `min_anchors` are left
    out before they are gathered.  A group is the anchors of one pair of
    sequences, each of which is a row itself.
    """
    fields = {f.name: f.dataType.simpleString() for f in found.schema}
    rows = found.select(*keys, F.col("q_pos").cast("long").alias("q_pos"), F.col("t_pos").cast("long").alias("t_pos")).distinct()
    if min_anchors > 1:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= min_anchors).drop("_n")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q_pos", "t_pos"])
        q, t = pdf["q_pos"].to_numpy(np.int64), pdf["t_pos"].to_numpy(np.int64)
        if all_chains:
            out = [(score, len(p), q[p[0]], q[p[-1]], t[p[0]], t[p[-1]], int((q[p] - t[p]).min()), int((q[p] - t[p]).max())) for score, p in disjoint(q, t, max(least, 1), weight, cost) if len(p) >= min_anchors]
        else:
            records, _ = best_chains(q, t, weight, cost)
            i = max(range(len(q)), key=lambda i: (records[i], q[i], t[i]))
            score, n, q0, t0 = records[i]
            out = [(score, n, q0, q[i], t0, t[i], 0, 0)] if score >= least and n >= min_anchors else []
        return pd.DataFrame(out, columns=["score", "n_anchors", "q_lo", "q_hi", "t_lo", "t_hi", "low", "high"]).assign(**{c: pdf[c].iloc[0] for c in keys})[[*keys, "score", "n_anchors", "q_lo", "q_hi", "t_lo", "t_hi", "low", "high"]]

    out = rows.groupBy(*keys).applyInPandas(link, ", ".join(f"{c} {fields[c]}" for c in keys) + f", {CHAIN}, low long, high long")
    return out if all_chains else out.drop("low", "high")


ALIGNMENT = "q_id string, t_id string, strand int, score int, q_start int, q_end int, t_start int, t_end int, cigar string, nm int"
#: Letters of a band beside the diagonals of a chain; bands are rounded up to powers of two of it.
HALF_BAND = 100


def align(queries: DataFrame, targets: DataFrame, k: int = 11, w: int = 5, min_anchors: int = 2, min_score: int = 20, per_query: int | None = None, long_gap: tuple[int, int] | None = LONG_GAP, both_strands: bool = True) -> DataFrame:
    """Alignments of queries (q_id, q_seq) to targets (t_id, t_seq), one for each chain of their shared minimizers.

    The band holds all diagonals of a chain, so that a gap of any length within
    it is one alignment.  Query ranges are on the strand that aligns.  Equal
    alignments of two chains are one.  With `per_query`, so many of the best by
    query.
    """
    found = anchors(queries, targets, k, w, both_strands)
    linked = chains(found, ["q_id", "t_id", "strand"], min_anchors)
    pairs = linked.select("q_id", "t_id", "strand", "low", "high").join(queries.select("q_id", "q_seq"), "q_id").join(targets.select("t_id", "t_seq"), "t_id")
    pairs = pairs.select(F.col("q_id").cast("string").alias("q_id"), F.col("t_id").cast("string").alias("t_id"), "strand", "low", "high", "q_seq", "t_seq")
    flip = str.maketrans("ACGT", "TGCA")
    names = [c.split()[0] for c in ALIGNMENT.split(", ")]

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reach = ((pdf["high"] - pdf["low"]) // 2).to_numpy() + HALF_BAND
            half = HALF_BAND << np.ceil(np.log2(np.maximum(reach / HALF_BAND, 1))).astype(np.int64)
            rows = []
            for size in np.unique(half):
                part = pdf[half == size]
                reads = [q.translate(flip)[::-1] if back else q for q, back in zip(part["q_seq"], part["strand"], strict=True)]
                hits = align_batch(reads, part["t_seq"].tolist(), ((part["high"] + part["low"]) // 2).tolist(), int(size), long_gap=long_gap)
                rows += [{"q_id": q, "t_id": t, "strand": back, **hit} for q, t, back, hit in zip(part["q_id"], part["t_id"], part["strand"], hits, strict=True) if hit and hit["score"] >= min_score]
            yield pd.DataFrame(rows, columns=names)

    out = pairs.mapInPandas(extend, ALIGNMENT).dropDuplicates(names)
    if per_query:
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "t_id", "strand", "t_start", "cigar"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= per_query).drop("_r")
    return out
