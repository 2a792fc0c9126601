"""Quality: a generalised additive model with pairwise interactions.

Features of a text are cut into bins.  Cyclic boosting visits one feature after
another, fits a tree of at most three leaves on its bins, and adds a small step
of it to the feature's lookup table; then pairs of features, chosen by how much
of what is left a 2 x 2 cut explains, get two-dimensional tables in the same
way.  A score is a sum of looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import remainder, sample
from ._store import keyed
from ._text import NOT_SPACE, Rolling, chunks, distinct, mix, word_bounds

#: The bound on labelled rows of each class that are learned from.
MAX_TRAIN = 6_000
FEATURES = (
    "log_bytes", "upper", "digit", "space", "newline", "stop", "sign", "bar", "bang", "non_ascii", "word_bytes",
    "repeats", "distinct_words", "distinct_pairs", "top_word", "sign_words", "upper_words", "bytes_a_line",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "upper": _class(bytes(range(65, 91))), "digit": _class(bytes(range(48, 58))), "space": ~NOT_SPACE, "newline": _class(b"\n"), "stop": _class(b".,;:?"),
    "sign": _class(b"#$%&*@^~<>=+{}[]\\/_"), "bar": _class(b"|"), "bang": _class(b"!"), "non_ascii": _class(bytes(range(128, 256))),
}
_CODE = np.zeros(256, np.uint8)  # the classes are disjoint but for newline, which space holds too
for _i, (_name, _mask) in enumerate(_CLASSES.items()):
    _CODE[_mask] = _i + 1


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk; an empty text has zeros."""
    n_docs = len(off) - 1
    size = np.diff(off)
    safe = np.maximum(size, 1)
    doc = np.repeat(np.arange(n_docs), size)
    width = len(_CLASSES) + 1
    kinds = np.bincount(doc * width + _CODE[data], minlength=n_docs * width).reshape(n_docs, width)
    col = {name: kinds[:, i + 1] / safe for i, name in enumerate(_CLASSES)}
    col["space"] = col["space"] + col["newline"]
    col["log_bytes"] = np.log1p(size)
    col["bytes_a_line"] = np.log1p(size / (kinds[:, list(_CLASSES).index("newline") + 1] + 1))
    starts, ends, d = word_bounds(data, off, NOT_SPACE)
    n = np.bincount(d, minlength=n_docs)
    some = np.maximum(n, 1)
    col["word_bytes"] = np.bincount(d, ends - starts, minlength=n_docs) / some
    h = Rolling(data).of(starts, ends)
    same = d[1:] == d[:-1]
    pairs = np.maximum(n - 1, 1)
    col["repeats"] = np.bincount(d[1:][same & (h[1:] == h[:-1])], minlength=n_docs) / pairs
    u, ud = distinct(h, d)
    col["distinct_words"] = np.bincount(ud, minlength=n_docs) / some
    order = np.lexsort((h, d))
    hs, ds = h[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])) if len(hs) else np.zeros(0, int)
    runs = np.diff(np.concatenate([new, [len(hs)]]))
    top = np.zeros(n_docs)
    np.maximum.at(top, ds[new], runs)
    col["top_word"] = top / some
    ph, pd = (mix(h[:-1] * np.uint64(3) + h[1:])[same], d[1:][same]) if len(h) > 1 else (h[:0], d[:0])
    col["distinct_pairs"] = np.bincount(distinct(ph, pd)[1], minlength=n_docs) / pairs
    last = data[ends - 1] if len(ends) else data[:0]
    col["sign_words"] = np.bincount(d[_CLASSES["sign"][last] | _CLASSES["bar"][last] | _CLASSES["bang"][last]], minlength=n_docs) / some
    second = data[np.minimum(starts + 1, ends - 1)] if len(ends) else data[:0]
    col["upper_words"] = np.bincount(d[_CLASSES["upper"][second]], minlength=n_docs) / some
    return np.stack([np.asarray(col[f], np.float64) for f in FEATURES], 1)


def all_features(texts: pa.Array) -> np.ndarray:
    parts = [features(data, off) for _, _, data, off in chunks(texts, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Newton steps by bin of a tree with at most `leaves` leaves that minimises squared loss; cuts leave `least` weight on both sides."""
    parts, lam = [(0, len(g))], 1.0
    gain_of = lambda a, b: a * a / (b + lam)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (lo, hi) in enumerate(parts):
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            if hi - lo < 2:
                continue
            left_g, left_h = cg[:-1], ch[:-1]
            gain = gain_of(left_g, left_h) + gain_of(cg[-1] - left_g, ch[-1] - left_h) - gain_of(cg[-1], ch[-1])
            gain[(left_h < least) | (ch[-1] - left_h < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], p, lo + k + 1)
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + lam)
    return out


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edge, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 150, n_pairs: int = 8, pair_rounds: int = 50, rate: float = 0.1) -> Model:
    """Cyclic boosting of one-feature tables, then of pair tables."""
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    edges = [_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    coarse = [_edges(x[:, f], coarse_bins) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Model(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if len(x) == 0 or y.min() == y.max():
        return model
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, b in enumerate(binned):
            p = 1 / (1 + np.exp(-z))
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b, y - p, minlength=n), np.bincount(b, p * (1 - p), minlength=n), 3, 1e-2)
            model.tables[f] += step
            z += step[b]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            na, nb = len(coarse[a]) + 1, len(coarse[b]) + 1
            flat = rough[a] * nb + rough[b]
            g = np.bincount(flat, y - p, minlength=na * nb).reshape(na, nb).cumsum(0).cumsum(1)
            h = np.bincount(flat, p * (1 - p), minlength=na * nb).reshape(na, nb).cumsum(0).cumsum(1)
            best = 0.0
            for i in range(na - 1):
                for j in range(nb - 1):
                    cells = [(m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]) for m in (g, h)]
                    best = max(best, sum(u * u / (v + 1) for u, v in zip(*cells, strict=True)))
            gains.append((best, a, b))
    for _, a, b in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((a, b))
        model.pair_tables.append(np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)))
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            na, nb = table.shape
            flat = rough[a] * nb + rough[b]
            g = np.bincount(flat, y - p, minlength=na * nb).reshape(na, nb)
            h = np.bincount(flat, p * (1 - p), minlength=na * nb).reshape(na, nb)
            cut = _tree(g.sum(1), h.sum(1), 2, 1e-2)  # first the one feature, then the other within both sides
            edge = int(np.flatnonzero(np.diff(cut))[0]) + 1 if np.diff(cut).any() else na
            step = np.zeros_like(table)
            for rows in (slice(0, edge), slice(edge, na)):
                if g[rows].size:
                    step[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 2, 1e-2)
            table += rate * step
            z += rate * step[rough[a], rough[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, keep, max_train: int = MAX_TRAIN) -> Model:
    """Fit on about `max_train` labelled rows of either class that `keep` admits, and on no more than 3 * `max_train` in all, whatever ids repeat.

    Where the classes are sampled at different rates, the intercept goes back to
    the share they have among all labelled rows, so that scores don't depend on
    the size of the table.
    """
    ids, rates = sample(labels, "quality", {0: max_train, 1: max_train}, keep)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text")  # ids: bounded by max_train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = all_features(batch.column(2))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["doc_id", "quality", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, quality int, x array<double>").drop("doc_id").orderBy(F.xxhash64("x"), "quality").limit(3 * max_train).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(got["x"].to_numpy())
    y = got["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    model = fit(x[order], y[order])
    if all(rates.get(v) for v in (0, 1)):
        model.intercept += float(np.log(rates[0] / rates[1]))  # odds in the sample are rates[1] / rates[0] times the odds of all rows
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted (1 at a score of exactly the threshold).

    Null texts are scored as empty, and an empty one from the model's constant.
    Long texts are scored whole, repeated rows each; an empty table gives no
    rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(all_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows, kind = keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn where crc32(doc_id) mod 3 is not 1, and score every row; a null id is never learned from nor held out."""
    out = scored(docs, train(docs, labels, remainder(3) != 1))
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
