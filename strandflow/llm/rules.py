"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them.

A rule looks at counts of one text and votes good (1), bad (-1) or abstains
(null).  How often each is right is not learned from labels: its rates on good
and bad texts and the share of good ones are those that make the votes of all
documents likeliest when rules err independently.  Only how often each pattern of votes occurs is
gathered for that, at most 3 to the number of rules, whatever the corpus.  A
text is kept if its posterior probability of being good is at least a half, so
that one rule that trips does not settle it and several weak ones can.

Words are runs of bytes between white space.  Equal lines and windows are found
by hash and confirmed on the words themselves, over whole texts.

Null texts count as empty, have no words and fail the base rule, as empty ones
do; null ids and repeated rows stay as they are; a posterior of exactly a half
keeps the text; an empty table gives no rows.  A long text is a chunk of its own.
Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._slices import group_slices
from ._store import keyed
from ._text import NOT_SPACE, U64, chunks, mix, word_bounds

#: Words of a window whose repetition counts.
WINDOW = 5
#: The base rule: words that a text needs, and percent of its words that repeated windows may hold.
BASE_WORDS, BASE_PERCENT = 10, 20
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct", "n_letter_words", "n_plain_words", "n_upper_words", "n_stops",
)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _STOP, _BREAK = _flags(SYMBOLS), _flags(b".!?"), ~_flags(b"\n")
_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 128)
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _within(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag)])
    return sums[ends] - sums[starts]


def repeated(of: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of `size` words that its document has twice or more; words by number, sorted by document."""
    n = len(of) - size + 1
    if n <= 0:
        return np.zeros(len(of), bool)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    with np.errstate(over="ignore"):
        h = mix(doc[at].astype(np.uint64))
        for j in range(size):
            h = mix(h + of[at + j].astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(j))
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]  # by hash; now by the words
    if not len(at):
        return np.zeros(len(of), bool)
    keys = [of[at + j] for j in range(size)] + [doc[at]]
    order = np.lexsort(keys)
    same = np.ones(len(at), bool)
    same[0] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    again = same | np.append(same[1:], False)
    edge = np.zeros(len(of) + 1, np.int64)
    np.add.at(edge, at[order][again], 1)
    np.add.at(edge, at[order][again] + size, -1)
    return np.cumsum(edge[:-1]) > 0


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES by document of a chunk (bytes, offsets)."""
    n = len(off) - 1
    by_doc = lambda doc, mask=None: np.bincount(doc if mask is None else doc[mask], minlength=n)
    starts, ends, doc = word_bounds(data, off, NOT_SPACE)
    of, first = group_slices(data, starts, ends)
    inside = lambda table: _within(table[data], off[:-1], off[1:])
    in_word = lambda table: _within(table[data], starts, ends)
    a, b, line_doc = word_bounds(data, off, _BREAK)
    full = _within(NOT_SPACE[data], a, b) > 0
    a, b, line_doc = a[full], b[full], line_doc[full]
    line, line_first = group_slices(data, a, b)
    last = np.searchsorted(starts, b, "left") - 1  # the last word of a line, of which there is one
    ended = _STOP[data[ends[last] - 1]] if len(last) else np.zeros(0, bool)
    distinct = lambda d, k, m: np.bincount(np.unique(d * max(m, 1) + k) // max(m, 1), minlength=n)
    letters, symbols, upper, lower = (in_word(t) for t in (_LETTER, _SYMBOL, _UPPER, _LOWER))
    lines = by_doc(line_doc)
    return np.stack([
        by_doc(doc), inside(NOT_SPACE & _HEAD), inside(_SYMBOL), lines - distinct(line_doc, line, len(line_first)), by_doc(doc, repeated(of, doc)), lines, by_doc(line_doc, ended),
        distinct(doc, of, len(first)), by_doc(doc, letters > 0), by_doc(doc, (letters > 0) & (symbols == 0)), by_doc(doc, (upper > 1) & (lower == 0)), inside(_STOP),
    ])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES of whole texts."""
    rows, kind = keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                cols = [pa.array(x.astype(np.int64)) for x in features(data, off)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], ["doc_id", *FEATURES])

    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in FEATURES)]))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's vote over FEATURES: 1, -1 or null.  A share counts only where there is enough to share."""
    words, lines = F.col("n_words"), F.col("n_lines")
    share = lambda name, of=words: F.col(name) / F.greatest(of, F.lit(1))
    vote = lambda bad=None, good=None: F.when(bad, -1).when(good, 1) if bad is not None and good is not None else F.when(bad, -1) if good is None else F.when(good, 1)
    enough, several = words >= 20, lines >= 5
    return {
        "length": vote(words < BASE_WORDS),
        "symbols": vote(share("n_symbols") > 0.1, (words >= BASE_WORDS) & (F.col("n_symbols") == 0)),
        "plain_words": vote(enough & (share("n_plain_words") < 0.8)),
        "letter_words": vote(enough & (share("n_letter_words") < 0.8)),
        "word_size": vote(enough & ((share("word_chars") > 12) | (share("word_chars") < 2.5))),
        "capitals": vote(enough & (share("n_upper_words") > 0.3)),
        "stops": vote(enough & (share("n_stops") > 0.5)),
        "line_ends": vote(several & (share("n_ended_lines", lines) < 0.2), (words >= BASE_WORDS) & (share("n_ended_lines", lines) > 0.8)),
        "repeated_lines": vote(several & (share("n_dup_lines", lines) > 0.3)),
        "repeated_words": vote(enough & (share("n_repeat_words") > 0.2), (words >= BASE_WORDS) & (F.col("n_repeat_words") == 0)),
        "variety": vote((words >= 50) & (words <= 5000) & (share("n_distinct") < 0.25)),
    }


@dataclass(frozen=True)
class LabelModel:
    """The share of good texts, and by rule how often it votes bad, abstains and votes good on bad and on good texts."""

    good: float
    on_bad: dict[str, tuple[float, float, float]]
    on_good: dict[str, tuple[float, float, float]]

    def accuracy(self, name: str) -> float:
        """How often the rule is right where it votes."""
        (bad_bad, _, bad_good), (good_bad, _, good_good) = self.on_bad[name], self.on_good[name]
        right, wrong = self.good * good_good + (1 - self.good) * bad_bad, self.good * good_bad + (1 - self.good) * bad_good
        return right / (right + wrong)

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability of a good text: prior log odds, and those of what each rule says."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, vote in votes.items():
            bad, none, good = (math.log(g / b) for b, g in zip(self.on_bad[name], self.on_good[name], strict=True))
            odds = odds + F.when(vote == -1, bad).when(vote == 1, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


#: What is assumed before any text is seen, with the weight of so many texts: how often a rule votes bad, abstains and votes good, and good and bad texts.
WEIGHT, ON_BAD, ON_GOOD, GOOD_PRIOR = 20.0, (0.3, 0.4, 0.3), (0.02, 0.4, 0.58), (8.0, 2.0)


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, rates on bad, rates on good) by expectation-maximisation over patterns of votes (patterns by rules) that occur n times.

    Which of the two kinds is good is settled by what is assumed before.
    """
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    on_bad, on_good = (np.tile(np.array(x), (votes.shape[1], 1)) for x in (ON_BAD, ON_GOOD))
    good = GOOD_PRIOR[0] / sum(GOOD_PRIOR)
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-np.clip(np.log(good / (1 - good)) + (shown * np.log(on_good / on_bad)).sum(axis=(1, 2)), -500, 500)))
        of_good, of_bad = n * post, n * (1 - post)
        new_good, new_bad = ((WEIGHT * np.array(before) + np.tensordot(w, shown, 1)) / (WEIGHT + w.sum()) for before, w in ((ON_GOOD, of_good), (ON_BAD, of_bad)))
        moved = max(float(np.abs(new_good - on_good).max()), float(np.abs(new_bad - on_bad).max()))
        on_good, on_bad = new_good, new_bad
        good = (GOOD_PRIOR[0] + of_good.sum()) / (sum(GOOD_PRIOR) + n.sum())
        if moved < tolerance:
            break
    return float(good), on_bad, on_good


def fit(counts: DataFrame, votes: dict[str, Column]) -> LabelModel:
    """The label model of a table of FEATURES; rows that fail the base rule vote too."""
    code = sum((F.coalesce(v, F.lit(0)) + 1) * 3**i for i, v in enumerate(votes.values()))
    seen = sorted(counts.groupBy(code.cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 3 ** rules rows
    codes, n = (np.array([r[i] for r in seen], np.int64) for i in (0, 1))
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(votes))], axis=1)
    good, on_bad, on_good = estimate(patterns, n.astype(float))
    return LabelModel(good, *({name: tuple(row) for name, row in zip(votes, rates.tolist(), strict=True)} for rates in (on_bad, on_good)))


def judged(docs: DataFrame, scratch) -> DataFrame:
    """doc_id, the counts of the base rule, base_failed, kept, the posterior and the votes; `scratch` holds the counts, so that texts are read once."""
    counts, votes = scratch.cut(counted(docs), "counts"), rules()
    model = fit(counts, votes)
    p = model.posterior(votes)
    shown = F.array(*(F.when(v == -1, f"-{name}").when(v == 1, f"+{name}") for name, v in votes.items()))
    return counts.select("doc_id", *FEATURES[:5], base_failed().alias("base_failed"), (~base_failed() & (p >= 0.5)).alias("kept"), p.alias("score"), F.array_compact(shown).alias("votes"))
