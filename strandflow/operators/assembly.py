"""A sequence for each cluster: a contig laid out over its reads' overlaps, a partial-order consensus of it, and votes that polish it."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import min_edge
from ..lineage import Scratch
from . import overlaps, poa
from .banded import best_alignments
from .consensus import polymers, read_polymers, recalibrate

#: Reads that are aligned in one call, and distinct pieces of one graph; a cluster with more is dealt to several, whose counts are summed.
SLICE = 32
#: Letters of a draft of which one graph makes a consensus.
WINDOW = 200


def votes(draft: str, reads: list[str]) -> tuple[np.ndarray, list[str], Counter]:
    """(counts by place and letter, the letters, '' for a deletion; how often each text is inserted behind a place) that aligned reads show."""
    letters = ["", *sorted({*draft, *"".join(reads)})]
    number = {c: i for i, c in enumerate(letters)}
    counts = np.zeros((len(draft), len(letters)), np.int64)
    after: Counter = Counter()
    for read, hit in zip(reads, best_alignments(reads, [draft] * len(reads)), strict=True):
        if not hit:
            continue
        codes = np.array([number[c] for c in read], np.int64)
        i, j = hit["q_start"], hit["t_start"]
        for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MID])", hit["cigar"])):
            if op == "M":
                counts[np.arange(j, j + n), codes[i : i + n]] += 1
            elif op == "D":
                counts[j : j + n, 0] += 1
            elif j:
                after[j - 1, read[i : i + n]] += 1
            i, j = i + n * (op != "D"), j + n * (op != "I")
    return counts, letters, after


def rebuilt(draft: str, counts: np.ndarray, letters: list[str], after: Counter, least: float = 0.5, edge: int = 1) -> str:
    """The draft after a vote, in which it has one voice itself; an edit needs the votes of `edge` reads."""
    own = np.array([letters.index(c) for c in draft], np.int64)
    counts = counts.copy()
    counts[np.arange(len(draft)), own] += 1
    top, best = counts.max(axis=1), counts.argmax(axis=1)  # letters are sorted: of equals the least
    keep = (counts[np.arange(len(draft)), own] == top) | (top < edge)
    voters = counts.sum(axis=1)
    most: dict[int, tuple[int, str]] = {}
    for (j, text), n in after.items():
        most[j] = max(most.get(j, (0, "")), (n, text))
    out = []
    for j, c in enumerate(draft):
        out.append(c if keep[j] else letters[best[j]])
        if j in most and most[j][0] > least * voters[j] and most[j][0] >= edge:
            out.append(most[j][1])
    return "".join(out)


def polish(draft: str, reads: list[str], rounds: int = 2, least: float = 0.5) -> str:
    """Majority of aligned bases at each place of the draft, with insertions and deletions that most reads share."""
    for _ in range(rounds):
        new = rebuilt(draft, *votes(draft, reads), least)
        if new == draft:
            break
        draft = new
    return draft


def pieces(draft: str, reads: list[str], window: int = WINDOW) -> list[tuple[int, str]]:
    """(window of the draft, what a read has there) for the windows that aligned reads span from end to end."""
    bounds = poa.windows(draft, window)
    out = []
    for read, hit in zip(reads, best_alignments(reads, [draft] * len(reads)), strict=True):
        if hit:
            at = poa.cut_at(hit, bounds)
            out += [(x, read[at[x] : at[x + 1]]) for x in range(len(bounds) - 1) if at[x] is not None and at[x + 1] is not None]
    return out


def assemble(reads: DataFrame, keys: list[str], rounds: int = 2, edge: int = 0, node_len: int = 0, min_overlap: int = overlaps.MIN_OVERLAP) -> DataFrame:
    """keys, assembly, is_assembled: from rows (keys, seg_id, seq, is_rep).

    The draft is the longest contig over the overlaps of a cluster's reads, for
    which two reads have to meet at as many places as `min_edge` asks for the
    number of reads, or `edge`.  Of three reads or more that don't overlap the
    representative one (or else that with the least seg_id) is the draft; fewer
    aren't assembled, and that read is returned.  A consensus of the reads'
    pieces by partial order follows, window by window, then `rounds` of votes
    by place, then lengths of homopolymers that most reads show.  An edit needs
    as many reads as an edge; what is shorter than `node_len` counts as not
    assembled.  Null sequences are left out.

    Reads are aligned in slices, and distinct pieces and counts by place are
    summed, so that a task holds a slice or a draft's counts and not a cluster.
    """
    fields = {f.name: f.dataType.simpleString() for f in reads.schema}
    head = ", ".join(f"{k} {fields[k]}" for k in keys)
    scratch = Scratch(reads.sparkSession, "assembly")
    rows = reads.where(F.col("seq").isNotNull()).select(*keys, "seg_id", "seq")
    pick = F.min_by(F.struct("seg_id", "seq"), F.struct(~F.coalesce("is_rep", F.lit(False)), "seg_id"))
    reps = reads.where(F.col("seq").isNotNull()).groupBy(*keys).agg(pick.alias("_d"), F.count(F.lit(1)).alias("_n"))
    many = reps.where("_n > 1").select(*keys, min_edge(F.col("_n"), edge).alias("edge"))
    laid = overlaps.layout(rows.join(many.select(*keys), keys, "left_semi"), keys, many, scratch, min_overlap=min_overlap)
    # the representative read is no voter where it is the draft itself
    drafts = reps.join(laid.select(*keys, "laid"), keys, "left").select(*keys, F.when(F.col("laid").isNull(), F.col("_d.seg_id")).alias("_own"), F.coalesce("laid", "_d.seq").alias("_draft"), "_n")
    drafts = scratch.cut(drafts, "drafts")
    alone = drafts.where("_own is not null and _n < 3")
    drafts = drafts.where("_own is null or _n >= 3")

    def others(pdf: pd.DataFrame) -> list[str]:
        return pdf["seq"][pdf["seg_id"] != pdf["_own"]].tolist()

    def same(pdf: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        return out.assign(**{k: pdf[k].iloc[0] for k in [*keys, "_own", "_n"]})

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        draft = pdf["_draft"].iloc[0]
        bounds = poa.windows(draft, WINDOW)
        found = [(x, 0, t) for x, t in pieces(draft, others(pdf))] + [(x, 1, draft[bounds[x] : bounds[x + 1]]) for x in range(len(bounds) - 1)]
        return same(pdf, pd.DataFrame(found, columns=["_at", "_kind", "_text"]))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        """The consensus of weighted pieces; a draft's own piece comes first and has one voice."""
        pdf = pdf.sort_values(["_kind", "_votes", "_text"], ascending=[False, False, True])
        text, n = poa.consensus([(t, 1 if kind else int(v)) for kind, t, v in zip(pdf["_kind"], pdf["_text"], pdf["_votes"], strict=True)])
        return same(pdf, pd.DataFrame({"_at": [pdf["_at"].iloc[0]], "_kind": [0], "_text": [text], "_votes": [n]}))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        draft = pdf["_draft"].iloc[0]
        if pdf["_settled"].iloc[0]:
            return same(pdf, pd.DataFrame({"_at": [-1], "_kind": [1], "_text": [draft], "_votes": [0]}))
        counts, letters, after = votes(draft, others(pdf))
        at, letter = np.nonzero(counts)
        out = [(-1, 0, draft, 0)] + [(j, 0, letters[c], int(counts[j, c])) for j, c in zip(at.tolist(), letter.tolist(), strict=True)] + [(j, 1, t, n) for (j, t), n in after.items()]
        return same(pdf, pd.DataFrame(out, columns=["_at", "_kind", "_text", "_votes"]))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        draft = pdf["_text"][pdf["_at"] < 0].iloc[0]
        letters = ["", *sorted({*draft, *pdf["_text"][(pdf["_at"] >= 0) & (pdf["_kind"] == 0)]} - {""})]
        base = pdf[(pdf["_at"] >= 0) & (pdf["_kind"] == 0)]
        counts = np.zeros((len(draft), len(letters)), np.int64)
        np.add.at(counts, (base["_at"].to_numpy(), base["_text"].map({c: i for i, c in enumerate(letters)}).to_numpy(np.int64)), base["_votes"].to_numpy())
        extra = pdf[(pdf["_at"] >= 0) & (pdf["_kind"] == 1)]
        after = Counter({(j, t): n for j, t, n in zip(extra["_at"], extra["_text"], extra["_votes"], strict=True)})
        new = draft if base.empty and extra.empty else rebuilt(draft, counts, letters, after, edge=edge_of(pdf))
        return pdf[[*keys, "_own", "_n"]].head(1).assign(_draft=new, _settled=new == draft)  # a vote that changes nothing isn't held again

    def edge_of(pdf: pd.DataFrame) -> int:
        n = int(pdf["_n"].iloc[0])
        return edge if edge > 0 else 1 + sum(n >= bound for bound in (5, 10, 40, 70))

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        draft = pdf["_draft"].iloc[0]
        regions, shown = polymers(draft), Counter()
        for read, hit in zip(pdf["seq"], best_alignments(pdf["seq"].tolist(), [draft] * len(pdf)), strict=True):
            if hit:
                shown.update(read_polymers(draft, regions, read, hit))
        return same(pdf, pd.DataFrame([(-1, 0, draft, 0)] + [(k, extra, t, n) for (k, t, extra), n in shown.items()], columns=["_at", "_kind", "_text", "_votes"]))

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        draft = pdf["_text"][pdf["_at"] < 0].iloc[0]
        seen: dict[int, Counter] = {}
        for at, kind, text, n in zip(pdf["_at"], pdf["_kind"], pdf["_text"], pdf["_votes"], strict=True):
            if at >= 0:
                seen.setdefault(at, Counter())[text, kind] += n
        return pdf[[*keys, "_own", "_n"]].head(1).assign(_draft=recalibrate([draft[a : b + 1] for a, b in polymers(draft)], seen), _settled=True)

    own = f"_own {fields['seg_id']}, _n long"
    counted = f"{head}, {own}, _at int, _kind int, _text string, _votes long"
    of = [*keys, "_own", "_n"]

    def dealt(drafts: DataFrame):
        return rows.join(drafts, keys).groupBy(*keys, F.pmod(F.xxhash64("seg_id"), F.ceil(F.col("_n") / SLICE)).alias("_part"))

    shown = dealt(drafts).applyInPandas(cut, f"{head}, {own}, _at int, _kind int, _text string").groupBy(*of, "_at", "_kind", "_text").agg(F.count(F.lit(1)).alias("_votes"))
    shown = scratch.cut(shown, "pieces")
    first = shown.where("_kind = 0").groupBy(*of, "_at", F.pmod(F.xxhash64("_text"), F.ceil(F.col("_n") / SLICE)).alias("_slice")).applyInPandas(graph, counted)
    piece = first.unionByName(shown.where("_kind = 1")).groupBy(*of, "_at").applyInPandas(graph, counted)
    drafts = piece.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_x")).select(*of, F.array_join(F.transform("_x", lambda x: x["_text"]), "").alias("_draft"), F.lit(False).alias("_settled"))
    for name, show, settle in [(f"votes{i}", count, fold) for i in range(rounds)] + [("lengths", runs, lengths)]:
        drafts = scratch.cut(drafts, name)  # also: a draft is made once, however often it is read
        shown = dealt(drafts).applyInPandas(show, counted)
        summed = shown.groupBy(*of, "_at", "_kind", "_text").agg(F.sum("_votes").alias("_votes"))
        drafts = summed.groupBy(*keys).applyInPandas(settle, f"{head}, {own}, _draft string, _settled boolean")
    text = F.regexp_replace("_draft", "N", "")
    done = drafts.select(*keys, text.alias("assembly"), (F.length(text) >= node_len).alias("is_assembled"))
    return done.unionByName(alone.select(*keys, text.alias("assembly"), F.lit(False).alias("is_assembled")))
