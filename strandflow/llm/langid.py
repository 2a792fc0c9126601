"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's vector is the mean of the embeddings of its hashed byte n-grams (2 to
5 bytes, letters only, words bounded by spaces).  Embeddings and softmax are
trained by stochastic gradient descent in numpy on a bounded sample of
documents, each as a whole and as three snippets; executors make the bags of
n-grams, so that what reaches the driver is bounded by rows and buckets however
long a text is.  Mean and softmax are linear, so that scoring adds up rows of
one table (embeddings times weights) by document.  A temperature is fitted on
bags kept apart, and so is the least score at which 99 % of the accepted are
right; below it a row is marked as rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import remainder
from ._store import keyed
from ._text import chunks

#: The bound on documents (rows) that are learned from, in all, or one for each language where these are more.  A row's bag has at most
#: BUCKETS entries of eight bytes, and an eighth of that at 2 kB of text, so that the driver gets some 50 MB and, of so many rows, never over 0.5 GB.
MAX_TRAIN = 1_500
SIZES, BUCKETS, DIM = (2, 3, 4, 5), 1 << 15, 16
#: Each text is learned from as a whole, and as snippets of so many words.
SNIPPET_WORDS = (3, 8, 25)
CHUNK = 256 << 10
#: ASCII letters and all bytes of other characters; what else there is bounds words.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of all n-grams of lower-cased bytes; white space, digits and signs count as one kind of gap."""
    n = len(data)
    norm = np.where(_LETTER[data], data, 32).astype(np.uint32)
    gap = norm == 32
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out_b, out_d = [], []
    for size in SIZES:
        if n < size:
            continue
        h = norm[: n - size + 1] * _MULTIPLIERS[0]
        both = gap[: n - size + 1].copy()
        for j in range(1, size):
            h ^= (h >> np.uint32(15)) + norm[j : n - size + 1 + j] * _MULTIPLIERS[j]
            h *= np.uint32(0x2C1B3C6D)
            if j < size - 1:
                both &= gap[j : n - size + 1 + j]
        ok = (doc[: n - size + 1] == doc[size - 1 :]) & ~both
        out_b.append((h[ok] >> np.uint32(17)).astype(np.int32))
        out_d.append(doc[: n - size + 1][ok])
    if not out_b:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(out_b), np.concatenate(out_d)


def _padded(texts: pa.Array) -> pa.Array:
    """Lower case, with a space before and after."""
    return pc.binary_join_element_wise("", pc.utf8_lower(texts.fill_null("")), "", " ")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times softmax weights; or the embeddings, where languages are more than dimensions
    bias: np.ndarray
    temperature: float
    threshold: float
    weights: np.ndarray | None = None  # dimensions x languages, beside embeddings

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probabilities by row; rows without n-grams have zeros."""
        out = np.zeros((len(texts), len(self.languages)), np.float64)
        for lo, hi, data, off in chunks(_padded(texts), CHUNK):
            b, d = ngrams(data, off)
            z = np.stack([np.bincount(d, self.table[b, k], minlength=hi - lo) for k in range(self.table.shape[1])], 1)
            z = z if self.weights is None else z @ self.weights
            n = np.bincount(d, minlength=hi - lo)
            z = (z / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            out[lo:hi] = np.where(n[:, None] > 0, p / p.sum(1, keepdims=True), 0)
        return out


def bags(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets of each text, and how often each occurs."""
    ids, counts = [], []
    for lo, hi, data, off in chunks(_padded(texts), CHUNK):
        b, d = ngrams(data, off)
        key, n = np.unique(d * BUCKETS + b, return_counts=True)
        cuts = np.searchsorted(key, np.arange(1, hi - lo) * BUCKETS)
        ids += np.split((key % BUCKETS).astype(np.int32), cuts)
        counts += np.split(n.astype(np.int32), cuts)
    return ids, counts


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its place in the sample's order, language and bags: of the whole text and of its snippets."""
    for batch in batches:
        order, lang, text = [], [], []
        for key, name, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = t.split()
            rng = np.random.default_rng(zlib.crc32(key.encode()))
            parts = [t]
            for size in SNIPPET_WORDS:
                at = int(rng.integers(0, max(1, len(words) - size + 1)))
                parts.append(" ".join(words[at : at + size]))
            order += [(key, t)] * len(parts)
            lang += [name] * len(parts)
            text += parts
        if not text:
            continue
        ids, counts = bags(pa.array(text, pa.string()))
        place = [zlib.crc32(f"{key}\0".encode() + t.encode()) for key, t in order]
        raw = [pa.array([x.tobytes() for x in bag], pa.binary()) for bag in (ids, counts)]  # as bytes, which the driver reads without a Python number for each
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(lang, pa.string()), *raw], ["place", "lang", "ids", "counts"])


def train(docs: DataFrame, keep, max_train: int = MAX_TRAIN, epochs: int = 4, seed: int = 7) -> Model | None:
    """Learn from text and lang of the rows that `keep` admits; None if there is nothing to learn from.

    All languages are learned.  About max_train / languages rows of each, at
    least one, are drawn by a hash of their ids, and no more than max_train rows
    or one a language reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(keep).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each language
    if not counts:
        return None
    share, scale = max(1, max_train // len(counts)), 1 << 30
    rates = docs.sparkSession.createDataFrame([(lang, int(scale * min(1.0, share / n))) for lang, n in counts.items()], "lang string, bound long")
    # of a language whose every hash is above its bound, the row of the least hash stands in
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    first = known.groupBy("lang").agg(F.min(drawn).alias("least")).join(rates, "lang").select("lang", F.greatest("bound", F.col("least") + 1).alias("bound"))
    some = known.join(F.broadcast(first), "lang").where(drawn < F.col("bound"))
    rows = some.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).mapInArrow(_learned, "place long, lang string, ids binary, counts binary")
    most = (1 + len(SNIPPET_WORDS)) * max(max_train, len(counts))
    rows = rows.orderBy("place", "lang", F.crc32("ids"), F.length("ids")).limit(most).toPandas()  # the order of arrival must not matter
    if not len(rows):
        return None
    languages = sorted(counts)
    y = rows["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    rng = np.random.default_rng(seed)
    apart = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    ids = [np.frombuffer(x, np.int32) for x in rows["ids"]]
    shares = [(n := np.frombuffer(x, np.int32)).astype(np.float32) / max(1, n.sum()) for x in rows["counts"]]
    k = len(languages)
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    w, bias = (rng.random((DIM, k), np.float32) - 0.5), np.zeros(k, np.float32)
    fit = np.array([i for i in np.flatnonzero(~apart) if len(ids[i])], int)
    steps, step = max(1, epochs * (-(-len(fit) // 32))), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // 32))):
            if not len(part):
                continue
            own, share = np.concatenate([ids[i] for i in part]), np.concatenate([shares[i] for i in part])
            n = np.array([len(ids[i]) for i in part])
            mean = np.add.reduceat(emb[own] * share[:, None], np.cumsum(n) - n)
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            rate = np.float32(1.0 * (1 - step / steps))
            back = (p @ w.T).astype(np.float32)
            w -= rate * (mean.T @ p) / len(part)
            bias -= rate * p.mean(0)
            move = np.repeat(rate * 8 * back, n, axis=0) * share[:, None]
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) > 0]))
            emb[own[order][first]] -= np.add.reduceat(move[order], first)
            step += 1
    model = Model(languages, emb, bias, 1.0, 0.0, w) if k > DIM else Model(languages, (emb @ w).astype(np.float32), bias, 1.0, 0.0)
    check = np.array([i for i in np.flatnonzero(apart) if len(ids[i])], int)
    if len(check) and k > 1:
        z = np.stack([share @ model.table[own] for own, share in ((ids[i], shares[i]) for i in check)])
        z = (z if model.weights is None else z @ model.weights) + bias

        def softmax(t: float) -> np.ndarray:
            q = np.exp(z / t - (z / t).max(1, keepdims=True))
            return q / q.sum(1, keepdims=True)

        loss = {t: -np.log(np.clip(softmax(t)[np.arange(len(check)), y[check]], 1e-12, 1)).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
        q = softmax(model.temperature)
        top, right = q.max(1), q.argmax(1) == y[check]
        order = np.argsort(-top)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(good >= 0.99)
        model.threshold = float(top[order][enough[-1]]) if len(enough) else 1.0
    return model


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected.

    Null texts, texts without a letter (Unicode's category L), and all texts if
    there is no model, are `und` with score 0 and rejected.  Of equal scores the
    first language by name counts.  Long texts are scored whole, repeated rows
    each; an empty table gives no rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(1)
            has = np.array([t.is_valid and letter.search(t.as_py()) is not None for t in texts], bool)
            if model is None or not len(texts):
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                p = model.scores(texts)
                score = np.where(has, p.max(1), 0)
                pred = [model.languages[i] if ok else "und" for i, ok in zip(p.argmax(1), has, strict=True)]
            low = (score < model.threshold) | ~has if model else np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows, kind = keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def language_query(docs: DataFrame) -> DataFrame:
    """Learn where crc32(doc_id) mod 5 is not 0, and predict every row; a null id is never learned from nor held out."""
    out = identified(docs, train(docs, remainder(5) != 0))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
