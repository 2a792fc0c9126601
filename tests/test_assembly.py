"""Contigs over overlaps, consensus by partial order, batched alignment, chains of minimizers, forests."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strandflow.functions import scoring
from strandflow.lineage import Scratch
from strandflow.operators import assembly, banded, chains, minimizers, overlaps, poa, seqjoin
from strandflow.plans import reads as plans


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def noisy(rng, s, rate):
    """Insertions and deletions alone, of equal rates."""
    out = []
    for c in s:
        x = rng.random()
        if x < rate / 2:
            continue
        if x < rate:
            out.append(rng.choice("ACGT"))
        out.append(c)
    return "".join(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, seg_id long, seq string, is_rep boolean")


def test_a_contig_is_longer_than_any_read(spark):
    rng = random.Random(2)
    t = dna(rng, 5_000)
    tiles = [(i, t[a : a + 1200]) for i, a in enumerate(range(0, 3900, 350))]
    rng.shuffle(tiles)
    rows = [("tiled", i, s, i == 3) for i, s in tiles]
    rows += [("tiled", 100 + j, t[a : a + 500], False) for j, a in enumerate((100, 1900, 2600))]  # contained in others
    rows += [("noisy", i, noisy(rng, t[a : a + 1500], 0.03), i == 0) for i, a in enumerate([x for x in range(0, 3600, 350) for _ in range(3)])]
    far = [dna(rng, 900) for _ in range(5)]
    rows += [("apart", i, s, i == 2) for i, s in enumerate(far)] + [("two", i, s, i == 1) for i, s in enumerate(far[:2])]
    got = {r.k: (r.assembly, r.is_assembled) for r in assembly.assemble(frame(spark, rows), ["k"]).collect()}
    assert got["tiled"] == (t[: 3850 + 1150], True)
    whole = t[: 3500 + 1500]
    hit = banded.best_alignments([got["noisy"][0]], [whole], half_band=200)[0]
    assert got["noisy"][1] and hit["t_end"] - hit["t_start"] > 4_900 and hit["nm"] <= 10, (hit, len(got["noisy"][0]))
    assert got["apart"] == (far[2], True)  # three reads or more that don't overlap: the representative one
    assert got["two"] == (far[1], False)  # fewer aren't assembled


def test_layout_keeps_only_neighbours(spark):
    rng = random.Random(4)
    t = dna(rng, 2_000)
    reads = frame(spark, [("k", i, t[a : a + 900], False) for i, a in enumerate(range(0, 1100, 100))] + [("k", 50, t[300:700], False), ("k", 51, t[:900], False)]).drop("is_rep")
    at = overlaps.places(reads, ["k"])
    inside = {r.seg_id for r in overlaps.contained(at, ["k"]).collect()}
    assert inside == {50, 51}  # one within others, and a copy
    links = overlaps.links(at.where(~at.seg_id.isin(50, 51)), ["k"]).collect()
    assert {(r.a, r.b, r["shift"]) for r in links} == {(i, i + 1, 100) for i in range(10)}
    edge = reads.select("k").distinct().withColumn("edge", overlaps.F.lit(3))
    assert [(r.laid, r.n_reads) for r in overlaps.layout(reads, ["k"], edge, Scratch(spark, "test")).collect()] == [(t[:1900], 11)]


def test_layout_in_a_group_equals_that_by_places(spark, monkeypatch, tmp_path):
    rng = random.Random(12)
    rows = []
    for c in range(6):
        t = dna(rng, 1_500) + "N" * 3 + "CA" * 20 + dna(rng, 900)
        cuts = [(a, a + rng.randrange(200, 700)) for a in (rng.randrange(0, 2_000) for _ in range(25))]
        rows += [(f"c{c}", c * 100 + i, noisy(rng, t[a:b], 0.01 * (c % 2)), False) for i, (a, b) in enumerate(cuts)]
    rows += [("apart", 900 + i, dna(rng, 400), False) for i in range(3)] + [("one", 990, dna(rng, 400), False), ("short", 991, "ACGT", False)]
    reads = frame(spark, rows).drop("is_rep")
    edge = reads.select("k").distinct().withColumn("edge", F.lit(2))
    made, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name, *a: made.append(name) or cut(self, df, name, *a))
    shown = lambda e: sorted(map(tuple, overlaps.layout(reads, ["k"], e, Scratch(spark, "test"), min_overlap=60).collect()))
    got = shown(edge)
    assert len(got) == 6 and "places" not in made and shown(2) == got  # places aren't written
    monkeypatch.setattr(overlaps, "GROUP_LETTERS", 8_000)
    assert shown(edge) == got and "places" in made
    monkeypatch.setattr(overlaps, "GROUP_LETTERS", 0)
    assert shown(2) == got


def test_minimizers_of_many_texts_are_those_of_each():
    rng = random.Random(13)
    texts = [dna(rng, rng.randrange(0, 90)) for _ in range(60)] + ["", "CA" * 40, "ACGTN" * 12, "A" * 30, dna(rng, 40) * 2]
    for k, w in ((15, 5), (5, 9), (30, 1)):
        want = []
        for i, t in enumerate(texts):
            at, h = minimizers.minimizer_places(np.frombuffer(t.encode("utf-32-le"), np.uint32), k, w)
            want += [(i, p, x) for p, x in zip(at.tolist(), h.tolist(), strict=True) if h.tolist().count(x) == 1]
        assert list(zip(*(x.tolist() for x in minimizers.all_places(texts, k, w)), strict=True)) == want


def test_paths_of_odd_graphs():
    sizes = {"a": 10, "b": 10, "c": 10, "d": 10}
    edges = [("a", "b", 5, 4, 0), ("b", "c", 5, 4, 0), ("a", "c", 1, 8, 0)]
    assert overlaps.longest_path(edges, sizes, 1) == [("a", 0, 4), ("b", 0, 4), ("c", 0, 10)]
    assert overlaps.longest_path([*edges, ("c", "a", 5, 4, 0)], {k: sizes[k] for k in "abc"}, 1) == [("a", 0, 4), ("b", 0, 4), ("c", 0, 10)]  # a circle
    assert overlaps.longest_path([("a", "b", 5, 4, 0)], sizes, 6) == [("a", 0, 10)]
    # b is entered behind the place at which it is left
    assert overlaps.longest_path([("a", "b", 5, 9, 5), ("b", "c", 5, 3, 1)], {k: 12 for k in "abc"}, 1) == [("a", 0, 9), ("b", 5, 5), ("c", 3, 12)]


def test_partial_order_recovers_what_votes_do_not():
    rng = random.Random(7)
    better = 0
    for _ in range(3):
        t = dna(rng, 300)
        reads = [noisy(rng, t, 0.12) for _ in range(24)]
        text, n = poa.consensus([(r, 1) for r in reads])
        assert n == 24
        off = lambda s: banded.align_batch([s], [t], [0], 60)[0]["nm"] + abs(len(s) - len(t))  # noqa: B023,E731
        assert off(text) <= 2
        better += off(text) < off(assembly.polish(reads[0], reads[1:]))
    assert better == 3


def test_partial_order_counts_weights():
    assert poa.consensus([("ACGT", 1), ("AGT", 3)]) == ("AGT", 4)
    assert poa.consensus([("ACGT", 2), ("AGT", 1), ("ACCGT", 1)]) == ("ACGT", 4)
    assert poa.consensus([("ACGTACGT", 1), ("ACGAACGT", 2)]) == ("ACGAACGT", 3)
    assert poa.consensus([("", 3)]) == ("", 3) and poa.consensus([("", 3), ("A", 1)]) == ("", 4)


def test_cuts_follow_the_alignment():
    hit = {"q_start": 2, "t_start": 10, "t_end": 22, "cigar": "2S5M3I2M2D3M"}
    assert poa.cut_at(hit, [0, 10, 14, 15, 17, 18, 19, 22, 30]) == [None, 2, 6, 10, 12, 12, 12, 15, None]
    assert poa.windows("x" * 450, 200) == [0, 225, 450] and poa.windows("x", 200) == [0, 1]


def test_batched_alignment_equals_single_ones():
    rng = random.Random(3)
    qs, ts = [], []
    for _ in range(120):
        t = dna(rng, rng.randrange(0, 300))
        a = rng.randrange(0, len(t) + 1)
        qs.append("" if rng.random() < 0.1 else dna(rng, rng.randrange(0, 20)) + noisy(rng, t[a : a + rng.randrange(0, 250)], rng.choice([0, 0.05, 0.2])) + dna(rng, rng.randrange(0, 20)))
        ts.append(t)
    for half, centre in ((100, 0), (20, 5), (3, -7), (40, 200)):
        for q, t, got in zip(qs, ts, banded.align_batch(qs, ts, [centre] * len(qs), half), strict=True):
            want = seqjoin.align_local(q, t, centre, half)
            assert (got and got["score"]) == (want and want["score"])
            if got:
                assert (got["q_end"], got["t_end"]) == (want["q_end"], want["t_end"]) and banded.worth(got, q, t) == got["score"]
        for q, t, got in zip(qs, ts, banded.align_batch(qs, ts, [centre] * len(qs), half, long_gap=(-8, -1)), strict=True):
            assert got is None or banded.worth(got, q, t, long_gap=(-8, -1)) == got["score"]


def test_minimizers_cover_windows_and_leave_periods_out():
    rng = random.Random(5)
    s = dna(rng, 500)
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    at, _ = minimizers.minimizer_places(codes, 11, 5)
    assert at[0] < 5 and at[-1] >= len(s) - 11 - 4 and np.diff(at).max() <= 5 and len(at) < 250
    for unit in ("A", "CA", "TTAGGG"):
        run = np.frombuffer((unit * 2000).encode("utf-32-le"), np.uint32)
        assert len(minimizers.minimizer_places(run, 11, 5)[0]) <= 6
    bad = np.frombuffer((s[:50] + "N" + s[50:100]).encode("utf-32-le"), np.uint32)
    assert not any(40 <= x <= 50 for x in minimizers.minimizer_places(bad, 11, 5)[0])
    assert len(minimizers.minimizer_places(codes[:5], 11, 5)[0]) == 0


def quadratic(q, t, weight, cost):
    out = []
    for i in range(len(q)):
        best = None
        for j in range(i):
            if q[j] < q[i] and t[j] < t[i]:
                gain = (out[j][0] - cost * (q[i] - q[j] + t[i] - t[j]), *out[j][1:])
                if gain[0] > 0 and (best is None or gain > best):
                    best = gain
        out.append((weight + best[0], best[1] + 1, *best[2:]) if best else (weight, 1, q[i], t[i]))
    return out


def test_chains_equal_all_pairs_of_anchors():
    rng = random.Random(1)
    for _ in range(150):
        at = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 40))})
        q, t = np.array([x for x, _ in at]), np.array([x for _, x in at])
        weight, cost = rng.choice([5, 20, 64]), rng.choice([1, 2])
        records, _ = chains.best_chains(q, t, weight, cost)
        assert records == quadratic(q.tolist(), t.tolist(), weight, cost)
        found = chains.disjoint(q, t, 1, weight, cost)
        assert len({i for _, p in found for i in p}) == sum(len(p) for _, p in found) == len(q)
        assert all(s == weight * len(p) - cost * sum(q[b] - q[a] + t[b] - t[a] for a, b in zip(p, p[1:], strict=False)) for s, p in found)
        assert found[0][0] == max(r[0] for r in records)


def test_one_alignment_across_a_long_gap(spark):
    rng = random.Random(8)
    a, b, c = dna(rng, 400), dna(rng, 400), dna(rng, 300)
    flip = (a + b)[::-1].translate(str.maketrans("ACGT", "TGCA"))
    q = spark.createDataFrame([("gap", a + b), ("back", flip), ("none", dna(rng, 300)), ("short", "ACG"), ("null", None)], "q_id string, q_seq string")
    t = spark.createDataFrame([("t", a + c + b), ("u", dna(rng, 500))], "t_id string, t_seq string")
    got = sorted((r.q_id, r.t_id, r.strand, r.q_start, r.q_end, r.t_start, r.t_end, "300D" in r.cigar) for r in chains.align(q, t).collect())
    assert got == [("back", "t", 1, 0, 800, 0, 1100, True), ("gap", "t", 0, 0, 800, 0, 1100, True)]


def test_texts_align_as_one_by_one(spark):
    rows = {(r.item_id, r.doc_id): r for r in plans.text_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    assert rows
    for (i, d), r in rows.items():
        assert banded.worth(r.asDict(), items[i], docs[d], long_gap=banded.LONG_GAP) == r.score
        assert items[i][r.q_start : r.q_end][:8] == docs[d][r.t_start : r.t_end][:8] or r.nm
    planted = {(i, d) for i, x in items.items() for d, y in docs.items() if len(x) > 40 and x in y}
    assert planted <= set(rows)


def test_forests_walk_as_nested_conditions(tmp_path):
    rng = np.random.default_rng(4)

    def grown(depth):
        t = {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "missing": []}

        def node(d):
            i = len(t["feature"])
            for c in t:
                t[c].append(None)
            t["missing"][i] = bool(rng.random() < 0.5)
            if d and rng.random() < 0.9:
                t["feature"][i], t["threshold"][i] = str(rng.choice(["x", "y", "z"])), float(rng.normal())
                t["left"][i], t["right"][i] = node(d - 1), node(d - 1)
            else:
                t["value"][i] = float(rng.normal())
            return i

        node(depth)
        return t

    def walk(t, row, i=0):
        if t["feature"][i] is None:
            return t["value"][i]
        v = row[t["feature"][i]]
        left = t["missing"][i] if v is None or np.isnan(v) else v <= t["threshold"][i]
        return walk(t, row, t["left"][i] if left else t["right"][i])

    trees = [grown(d) for d in (0, 1, 3, 5, 7)]
    df = pd.DataFrame({c: np.where(rng.random(200) < 0.1, np.nan, rng.normal(size=200)) for c in "xyz"})
    (tmp_path / "m.json").write_text(json.dumps({"trees": trees, "bias": 0.25, "average": True, "logistic": False}))
    model = scoring.load(str(tmp_path / "m.json"))
    assert np.allclose(model(df), [0.25 + sum(walk(t, r) for t in trees) / 5 for r in df.to_dict("records")])
    boosted = scoring.Forest(trees, 0.25)
    assert np.allclose(boosted(df), [1 / (1 + np.exp(-0.25 - sum(walk(t, r) for t in trees))) for r in df.to_dict("records")])
    assert len(model(df.head(0))) == 0
    with pytest.raises(ValueError):
        scoring.Forest([{"feature": ["x"], "threshold": [0], "left": [0], "right": [0], "value": [None]}])
