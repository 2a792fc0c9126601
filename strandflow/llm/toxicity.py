"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters.  One for each word of a fixed lexicon, one for each word prefix that
labelled toxic texts use far more often than others (found on a bounded sample,
each with the rate above which it votes), and voters for clean texts, which
nothing or hardly anything speaks against.  A voter says toxic, clean or nothing.

Label model.  Expectation maximisation estimates for each voter how often it
says what in either class, and the share of toxic texts.  Correlations between
voters within a class, weighted by the posterior, then discount voters that
repeat each other, and the estimate is made again.

Classifier.  A logistic regression on hit counts and rates is trained on the
posterior labels, not on the given ones; the given labels only choose prefixes
and rates and set the final scale.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import remainder, sampled_ids
from ._store import keyed
from ._text import Rolling, chunks, hash_bytes, word_bounds

#: The bounds on labelled rows of either class that are learned from (sampled by id; no more than twice as many rows where ids repeat).
MAX_TOXIC, MAX_CLEAN = 4_000, 6_000
#: The number of voters of the model beside the lexicon: the strongest of all prefixes that labelled toxic texts use far more often.
PATTERNS = 48
PREFIX_LENGTHS = range(4, 11)
THRESHOLD = 0.3

#: Plain insults in four languages.
LEXICON = (
    "idiot", "moron", "stupid", "clown", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "vermin", "filth", "bastard", "freak",
    "trottel", "dummkopf", "abschaum", "arschloch", "vollidiot", "imbécile", "connard", "crétin", "abruti", "ordure", "imbécil", "estúpido", "basura", "escoria", "cabrón", "tonto",
)
WORD = re.compile(r"[^\W\d_]+")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    patterns: list[str]
    whole: list[bool]  # a whole word (lexicon) or any word that begins so
    weights: np.ndarray | None = None
    rates: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)
    accuracies: dict[str, float] = field(default_factory=dict)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x patterns, words by row)."""
        raw = [p.encode() for p in self.patterns]
        keys = hash_bytes(raw)
        groups: dict[tuple[int, bool], list[int]] = {}
        for i, (p, whole) in enumerate(zip(raw, self.whole, strict=True)):
            groups.setdefault((len(p), whole), []).append(i)
        hits = np.zeros((len(texts), len(raw)), np.int32)
        words = np.zeros(len(texts), np.int64)
        for lo, hi, data, off in chunks(pc.utf8_lower(texts.fill_null(""))):
            starts, ends, doc = word_bounds(data, off, _LETTER)
            words[lo:hi] = np.bincount(doc, minlength=hi - lo)
            rolling = Rolling(data)
            for (size, whole), own in groups.items():
                fits = np.flatnonzero(ends - starts == size if whole else ends - starts >= size)
                if not len(fits):
                    continue
                h = rolling.of(starts[fits], starts[fits] + size)
                order = np.argsort(keys[own])
                some, ids = keys[own][order], np.array(own)[order]
                k = np.minimum(np.searchsorted(some, h), len(some) - 1)
                hit = some[k] == h
                np.add.at(hits, (lo + doc[fits[hit]], ids[k[hit]]), 1)
        return hits, words

    def inputs(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        rate = 100 * hits / np.maximum(words, 1)[:, None]
        total, most = hits.sum(1), rate.max(1, initial=0)
        return np.concatenate([np.log1p(hits), np.minimum(rate, 5), np.log1p(total)[:, None], np.minimum(rate.sum(1), 10)[:, None], np.minimum(most, 5)[:, None], (total == 0)[:, None], np.ones((len(hits), 1))], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        hits, words = self.counts(texts)
        if self.weights is None:  # nothing to learn from: the lexicon alone
            return np.where(hits.sum(1) > 0, 0.9, 0.02)
        z = self.scale[0] * (self.inputs(hits, words) @ self.weights) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def votes(hits: np.ndarray, words: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Rows x voters of 1 (toxic), -1 (clean) and 0: the patterns, and three voters for clean texts."""
    rate = hits / np.maximum(words, 1)[:, None]
    v = ((hits > 0) & (rate >= rates)).astype(np.int8)
    none = np.where(hits.sum(1) == 0, -1, 0)
    weak = np.where(rate.max(1, initial=0) < 0.003, -1, 0)
    single = np.where((hits.sum(1) <= 1) & (words >= 150), -1, 0)
    return np.concatenate([v, none[:, None], weak[:, None], single[:, None]], 1).astype(np.int8)


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic by row, chance of each voter's saying -1, 0, 1 by class, discounts for correlation)."""
    n, m = v.shape
    post = np.clip(prior + 0.4 * np.tanh((v == 1).sum(1) - (v == -1).sum(1)), 0.02, 0.98)
    weight = np.ones(m)
    theta = np.zeros((2, m, 3))
    # What is believed beforehand, in rows: a voter rarely speaks against its class, which keeps the classes from changing places.
    against = (v == -1).any(0)[:, None]
    belief = (np.where(against, [8.0, 2.0, 0.0], [0.0, 20.0, 0.1]) + 0.01, np.where(against, [2.0, 18.0, 0.0], [0.0, 4.5, 0.5]) + 0.01)
    for again in range(2):
        for _ in range(rounds):
            share = np.clip(post.mean(), 0.25 * prior, 4 * prior)
            for c, p in ((1, post), (0, 1 - post)):
                for k, said in enumerate((-1, 0, 1)):
                    theta[c, :, k] = (p @ (v == said) + belief[c][:, k]) / (p.sum() + belief[c].sum(1))
            z = np.full(n, np.log(share / (1 - share)))
            for k, said in enumerate((-1, 0, 1)):
                z += (v == said) @ (weight * (np.log(theta[1, :, k]) - np.log(theta[0, :, k])))
            post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if again:
            break
        linked = np.zeros((m, m))
        for p in (post, 1 - post):
            x = v - (p @ v) / max(p.sum(), 1e-9)
            cov = (x * p[:, None]).T @ x / max(p.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            linked = np.maximum(linked, np.abs(cov) / np.outer(sd, sd))
        np.fill_diagonal(linked, 0)
        linked[linked < 0.2] = 0
        weight = 1 / (1 + linked.sum(1))
    return post, theta, weight


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton steps for soft labels; the last column is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _prefixes(text: str) -> Counter:
    """Occurrences of word prefixes; the empty prefix counts all words."""
    words = WORD.findall(text.lower())
    out: Counter = Counter({"": len(words)})
    for w, n in Counter(words).items():
        for size in PREFIX_LENGTHS:
            if len(w) >= size:
                out[w[:size]] += n
    return out


def _df(only: frozenset[str] | None):
    """Documents and occurrences by prefix, added up in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, seen = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0):
                own = _prefixes(t.as_py() or "")
                if only is not None:
                    own = {p: n for p, n in own.items() if p in only or not p}
                docs.update(own.keys())
                seen.update(own)
        keys = list(docs)
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([docs[k] for k in some], pa.int64()), pa.array([seen[k] for k in some], pa.int64())], ["prefix", "docs", "seen"])

    return run


def train(docs: DataFrame, labels: DataFrame, keep) -> Model:
    """Find voters and fit the models on a bounded sample of the labelled rows that `keep` admits."""
    model = Model(list(LEXICON), [True] * len(LEXICON))
    ids = sampled_ids(labels, "toxic", {0: MAX_CLEAN, 1: MAX_TOXIC}, keep)
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")  # ids: bounded by MAX_CLEAN + MAX_TOXIC
    n = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return model
    schema = "prefix string, docs long, seen long"
    total = lambda df: df.groupBy("prefix").agg(F.sum("docs").alias("docs"), F.sum("seen").alias("seen"))
    toxic = total(known.where("toxic = 1").select("text").mapInArrow(_df(None), schema)).where((F.col("docs") >= (3 if n[1] < 100 else max(6, n[1] // 100))) | (F.col("prefix") == ""))
    first = {"": (0, 0)} | {r["prefix"]: (r["docs"], r["seen"]) for r in toxic.collect()}  # each in 1 % of at most MAX_TOXIC texts: bounded by their words
    clean = {r["prefix"]: (r["docs"], r["seen"]) for r in total(known.where("toxic = 0").select("text").mapInArrow(_df(frozenset(first)), schema)).collect()}
    ranked = []
    for p, (a, seen) in first.items():
        b, other = clean.get(p, (0, 0))
        ratio = (seen / max(first[""][1], 1)) / ((other + 1) / max(clean.get("", (0, 0))[1], 1)) if p else 0
        p1, p0 = a / n[1], (b + 1) / (n[0] + 1)
        both = (a + b) / (n[1] + n[0])
        z = (p1 - p0) / np.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0]) + 1e-12)
        if ratio >= 5 and p1 >= 3 * p0 and z >= 5:
            ranked.append((-round(a * np.log(ratio), 6), -len(p), p))
    lexicon = set(LEXICON)
    kept: list[str] = []
    for _, _, p in sorted(ranked):
        if len(kept) < PATTERNS and not any(p.startswith(q) or q.startswith(p) for q in kept) and not any(w.startswith(p) for w in lexicon):
            kept.append(p)
    model = Model([*LEXICON, *kept], [True] * len(LEXICON) + [False] * len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, words = model.counts(batch.column(2))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(hits.ravel()), len(model.patterns)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(words)], ["doc_id", "toxic", "hits", "words"])

    kind = known.schema["doc_id"].dataType.simpleString()
    got = known.mapInArrow(run, f"doc_id {kind}, toxic int, hits array<int>, words long").drop("doc_id").orderBy(F.xxhash64("hits", "words"), "toxic").limit(2 * (MAX_TOXIC + MAX_CLEAN)).toPandas()
    if got["toxic"].nunique() < 2:
        return Model(list(LEXICON), [True] * len(LEXICON))
    hits, words, y = np.stack(got["hits"].to_numpy()), got["words"].to_numpy(), got["toxic"].to_numpy(float)
    order = np.lexsort((*hits.T, words, y))
    hits, words, y = hits[order], words[order], y[order]
    rate = hits / np.maximum(words, 1)[:, None]
    rates = np.zeros(len(model.patterns))
    for j in range(len(model.patterns)):
        own = rate[:, j][hits[:, j] > 0]
        best = (-np.inf, 0.0)
        for cut in np.unique(np.quantile(own, np.linspace(0, 0.9, 19))) if len(own) else ():
            said = (hits[:, j] > 0) & (rate[:, j] >= cut)
            best = max(best, ((y * said).sum() - 2 * ((1 - y) * said).sum(), float(cut)), key=lambda t: t[0])
        rates[j] = best[1]
    v = votes(hits, words, rates)
    post, theta, _ = label_model(v, float(y.mean()))
    x = model.inputs(hits, words)
    model.rates = rates
    model.weights = logistic(x, post)
    z = x @ model.weights
    base = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    counts = sampled_share(n, labels, keep)
    platt = logistic(np.stack([np.clip(z, -30, 30), np.ones(len(z))], 1), y, 1e-3)
    model.scale = (float(platt[0]), float(platt[1] + np.log(counts / (1 - counts)) - base))
    model.accuracies = {p: float(theta[1, j, 2] / (theta[1, j, 2] + theta[0, j, 2])) for j, p in enumerate(model.patterns)}
    return model


def sampled_share(n: dict[int, int], labels: DataFrame, keep) -> float:
    """The share of toxic rows among all labelled ones, which the sample by class may have changed."""
    share = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(keep).agg(F.avg(F.col("toxic").cast("double")).alias("x")).first()["x"]
    return float(np.clip(share if share is not None else n[1] / (n[0] + n[1]), 1e-3, 1 - 1e-3))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted (1 at a score of exactly the threshold).

    Null texts are scored as empty, and an empty one from the model's constant.
    Long texts are scored whole, repeated rows each; an empty table gives no
    rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows, kind = keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below `threshold`; null and empty texts are scored as empty, repeated rows each, an empty table stays empty."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], names).filter(pa.array(model.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn where crc32(doc_id) mod 4 is not 2, and score every row; a null id is never learned from nor held out."""
    out = scored(docs, train(docs, labels, remainder(4) != 2))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
