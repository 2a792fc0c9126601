"""Sequence-similarity join: k-mer seeds, diagonal chains, banded extension of many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .banded import align_batch, best_alignments


def kmers(seq: Column, k: int) -> Column:
    """array<struct<pos,kmer>> of all k-mers without N."""
    at = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k)).otherwise(F.array().cast("array<int>"))
    all_ = F.transform(at, lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))
    return F.filter(all_, lambda x: ~x["kmer"].contains("N"))


def seeds(queries: DataFrame, targets: DataFrame, k: int = 11) -> DataFrame:
    """(q_id, t_id, strand, q_pos, t_pos) for each shared k-mer; queries (q_id, q_seq) are taken on both strands."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("q_seq").alias("s")), F.struct(F.lit(1).alias("strand"), F.reverse(F.translate("q_seq", "ACGT", "TGCA")).alias("s"))))
    q = queries.select("q_id", both.alias("o")).select("q_id", "o.strand", F.explode(kmers(F.col("o.s"), k)).alias("x")).select("q_id", "strand", F.col("x.pos").alias("q_pos"), F.xxhash64("x.kmer").alias("h"), F.col("x.kmer").alias("kmer"))
    t = targets.select("t_id", F.explode(kmers(F.col("t_seq"), k)).alias("x")).select("t_id", F.col("x.pos").alias("t_pos"), F.xxhash64("x.kmer").alias("h"), F.col("x.kmer").alias("kmer"))
    return q.join(t, ["h", "kmer"]).select("q_id", "t_id", "strand", "q_pos", "t_pos")


def word_grams(df: DataFrame, key: str, text: str = "text", n: int = 8) -> DataFrame:
    """key, p (from 1), gram: the strings of n words of whole texts, words being what single spaces part."""
    w = df.select(key, F.split(text, " ").alias("_w")).where(F.size("_w") >= n).select(key, "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - (n - 1))).alias("p"))
    return w.select(key, F.col("p").cast("long").alias("p"), F.array_join(F.slice("_w", F.col("p"), F.lit(n)), " ").alias("gram"))


def shared_grams(a: DataFrame, b: DataFrame, a_key: str, b_key: str, n: int = 8) -> DataFrame:
    """a_key, p, b_key, ip, gram: the places of texts at which both have the same n words.

    Grams of `a` are dropped by their hashes first, which Spark broadcasts if
    those of `b` are few; so only what may match is shuffled with its words.
    """
    theirs = word_grams(b, b_key, n=n).withColumnRenamed("p", "ip").withColumn("_h", F.xxhash64("gram"))
    mine = word_grams(a, a_key, n=n).withColumn("_h", F.xxhash64("gram")).join(theirs.select("_h").distinct(), "_h", "left_semi")
    return mine.join(theirs, ["_h", "gram"]).drop("_h")


def chains(found: DataFrame, band: int = 64) -> DataFrame:
    """Seeds gathered by diagonal band: how many, and the stretch that they cover."""
    diag = F.floor((F.col("q_pos") - F.col("t_pos")) / band)
    return found.groupBy("q_id", "t_id", "strand", diag.alias("diag")).agg(F.count(F.lit(1)).alias("n_seeds"), F.min("q_pos").alias("q_lo"), F.max("q_pos").alias("q_hi"), F.min("t_pos").alias("t_lo"), F.max("t_pos").alias("t_hi"))


def kmer_runs(seq: Column, k: int) -> Column:
    """array<struct<pos,kmer,size>>: k-mers without N, of which those that follow each other and are equal (a run of one letter) are one entry."""
    new = lambda x: (x["pos"] == 0) | (F.substring(seq, x["pos"], F.lit(k)) != x["kmer"])
    one_letter = lambda x: x["kmer"] == F.repeat(F.substring(x["kmer"], 1, 1), k)
    run = lambda x: F.length(F.regexp_extract(F.substring(seq, x["pos"] + 1, F.length(seq)), r"^(.)\1*", 0)) - (k - 1)
    return F.transform(F.filter(kmers(seq, k), new), lambda x: F.struct(x["pos"].alias("pos"), x["kmer"].alias("kmer"), F.when(one_letter(x), run(x)).otherwise(1).alias("size")))


def chained(queries: DataFrame, targets: DataFrame, k: int = 11, band: int = 64) -> DataFrame:
    """What `chains` makes of `seeds`, without a row for each seed: two runs of one letter meet once, and give a row for each band between them.

    So tails of A, which many sequences share, cost their number and not the
    square of their length.
    """
    both = F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("q_seq").alias("s")), F.struct(F.lit(1).alias("strand"), F.reverse(F.translate("q_seq", "ACGT", "TGCA")).alias("s"))))
    hashed = (F.xxhash64("x.kmer").alias("h"), F.col("x.kmer").alias("kmer"))
    q = queries.select("q_id", both.alias("o")).select("q_id", "o.strand", F.explode(kmer_runs(F.col("o.s"), k)).alias("x")).select("q_id", "strand", F.col("x.pos").alias("q_pos"), F.col("x.size").alias("m"), *hashed)
    t = targets.select("t_id", F.explode(kmer_runs(F.col("t_seq"), k)).alias("x")).select("t_id", F.col("x.pos").alias("t_pos"), F.col("x.size").alias("n"), *hashed)
    met = q.join(t, ["h", "kmer"]).withColumn("at", F.col("q_pos") - F.col("t_pos"))
    lo, hi = F.col("at") - (F.col("n") - 1), F.col("at") + (F.col("m") - 1)
    met = met.withColumn("diag", F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band))))
    met = met.withColumns({"lo": (F.greatest(lo, F.col("diag") * band) - F.col("at")).cast("int"), "hi": (F.least(hi, F.col("diag") * band + (band - 1)) - F.col("at")).cast("int")})
    # on the diagonal d of two runs of m and n places lie min(m, n + d) - max(0, d) pairs
    m, n = F.col("m"), F.col("n")
    many = F.aggregate(F.sequence("lo", "hi"), F.lit(0).cast("long"), lambda a, d: a + F.least(m, n + d) - F.greatest(d, F.lit(0)))
    count = F.when((m == 1) | (n == 1), (F.col("hi") - F.col("lo") + 1).cast("long")).otherwise(many)
    return met.groupBy("q_id", "t_id", "strand", "diag").agg(
        F.sum(count).alias("n_seeds"), F.min(F.col("q_pos") + F.greatest("lo", F.lit(0))).alias("q_lo"), F.max(F.col("q_pos") + F.least(m, n + F.col("hi")) - 1).alias("q_hi"),
        F.min(F.col("t_pos") + F.greatest(-F.col("hi"), F.lit(0))).alias("t_lo"), F.max(F.col("t_pos") + F.least(n, m - F.col("lo")) - 1).alias("t_hi"),
    )


MATCH, MISMATCH, OPEN, EXTEND = 2, -4, -4, -2


def align_local(q: str, t: str, centre: int, half_band: int = 100) -> dict | None:
    """Best local alignment with affine gaps near the diagonal q - t = centre: score, ranges, CIGAR (with soft clips), edits.

    One pair at a time, as the rule for `banded.align_batch`, which the dataflow uses.
    """
    n, m = len(q), len(t)
    if not n or not m:
        return None
    a, b = np.frombuffer(q.encode(), np.uint8), np.frombuffer(t.encode(), np.uint8)
    width = 2 * half_band + 1
    low = -10**9
    h_prev = np.full(width + 2, 0)
    f_prev = np.full(width + 2, low)
    back = np.zeros((n + 1, width), np.int8)
    best = (0, 0, 0)
    offsets = np.arange(width)
    for i in range(1, n + 1):
        j = i - centre - half_band + offsets  # target length used, by band cell
        ok = (j >= 1) & (j <= m)
        s = np.where(ok & (a[i - 1] == b[np.clip(j - 1, 0, m - 1)]), MATCH, MISMATCH)
        diag = h_prev[:width] + s
        f = np.maximum(h_prev[1 : width + 1] + OPEN, f_prev[1 : width + 1] + EXTEND)  # gap in the target: query letter alone
        base = np.where(ok, np.maximum(np.maximum(diag, f), 0), 0)
        run = base - EXTEND * offsets  # gap in the query: a running maximum along the row
        top = np.maximum.accumulate(run)
        e = np.concatenate([[low], top[:-1] + EXTEND * offsets[1:] + (OPEN - EXTEND)])
        h = np.where(ok, np.maximum(base, e), 0)
        step = np.where(h == 0, 0, np.where(h == diag, 1, np.where(h == f, 2, 3)))
        back[i] = np.where(ok, step, 0)
        h_prev = np.concatenate([h, [0, 0]])
        f_prev = np.concatenate([np.where(ok, f, low), [low, low]])
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), i, k)
    if not best[0]:
        return None
    score, i, k = best
    q_end, t_end = i, i - centre - half_band + k
    ops: list[list] = []
    edits = 0
    while i > 0 and 0 <= k < width and back[i, k]:
        way = int(back[i, k])
        j = i - centre - half_band + k
        op = "M" if way == 1 else "I" if way == 2 else "D"
        edits += way != 1 or a[i - 1] != b[j - 1]
        if ops and ops[-1][1] == op:
            ops[-1][0] += 1
        else:
            ops.append([1, op])
        if way == 1:
            i -= 1
        elif way == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
    j = i - centre - half_band + k
    cigar = "".join(f"{x}{o}" for x, o in ([[i, "S"]] if i else []) + ops[::-1] + ([[n - q_end, "S"]] if n - q_end else []))
    return {"score": score, "q_start": i, "q_end": q_end, "t_start": max(j, 0), "t_end": t_end, "cigar": cigar, "nm": int(edits)}


ALIGNMENT = "q_id string, t_id string, strand int, score int, q_start int, q_end int, t_start int, t_end int, cigar string, nm int"


def align(queries: DataFrame, targets: DataFrame, k: int = 11, min_seeds: int = 2, min_score: int = 20, band: int = 64, per_query: int | None = None) -> DataFrame:
    """Alignments of queries (q_id, q_seq) to targets (t_id, t_seq), one for each chained diagonal band.

    Query ranges are on the strand that aligns; a chain and its neighbour band
    are one alignment.  With `per_query`, only so many of the best by query.
    """
    found = chained(queries, targets, k, band)
    w = Window.partitionBy("q_id", "t_id", "strand").orderBy("diag")
    joined = found.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(w) <= 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    run = joined.groupBy("q_id", "t_id", "strand", "_run").agg(F.sum("n_seeds").alias("n"), F.max_by("diag", F.struct("n_seeds", "diag")).alias("diag")).where(F.col("n") >= min_seeds)
    pairs = run.join(queries.select("q_id", "q_seq"), "q_id").join(targets.select("t_id", "t_seq"), "t_id").select(F.col("q_id").cast("string").alias("q_id"), F.col("t_id").cast("string").alias("t_id"), "strand", "diag", "q_seq", "t_seq")
    flip = str.maketrans("ACGT", "TGCA")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            queries = [q.translate(flip)[::-1] if back else q for q, back in zip(pdf["q_seq"], pdf["strand"], strict=True)]
            hits = align_batch(queries, pdf["t_seq"].tolist(), [int(d) * band + band // 2 for d in pdf["diag"]])
            rows = [{"q_id": q, "t_id": t, "strand": back, **hit} for q, t, back, hit in zip(pdf["q_id"], pdf["t_id"], pdf["strand"], hits, strict=True) if hit and hit["score"] >= min_score]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNMENT.split(", ")])

    out = pairs.mapInPandas(extend, ALIGNMENT)
    if per_query:
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "t_id", "strand", "t_start"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= per_query).drop("_r")
    return out


def best_alignment(q: str, t: str, k: int = 11, half_band: int = 100) -> dict | None:
    """The alignment of one pair along its best-seeded diagonal, or None without a seed."""
    return best_alignments([q], [t], k, half_band)[0]


PAIR = "struct<score:int,q_start:int,q_end:int,t_start:int,t_end:int,cigar:string,nm:int>"


def align_pairs(df: DataFrame, pairs: dict[str, tuple[str, str]], min_score: int = 20) -> DataFrame:
    """The rows with one struct column for each named (query column, target column); null without an alignment."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{name} {PAIR}" for name in pairs)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = {name: [h if h and h["score"] >= min_score else None for h in best_alignments(pdf[a].tolist(), pdf[b].tolist())] for name, (a, b) in pairs.items()}
            yield pdf.assign(**{name: pd.Series(h, index=pdf.index, dtype=object) for name, h in hits.items()})

    return df.mapInPandas(run, fields)
