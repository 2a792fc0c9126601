"""Benchmark decontamination with one Aho-Corasick automaton over normalised word sequences.

The automaton's alphabet is the benchmark's own words: a document is scanned
once as a sequence of word numbers (0 for words that no item has), so that a
window costs at most one state a word and not one a letter.  Word positions map
back to byte and code point offsets of the original text.

States, failure links and a hash table of transitions are flat arrays of about
40 bytes a state, built level by level on the driver and broadcast; a worker
keeps them from task to task.  Texts are cut into segments of SEGMENT words that
begin a window's length early, which is all that a state depends on, and all
segments of a chunk advance together, however long a text is.

A benchmark beyond MOST_STATES or `block_bytes` is cut into parts by a hash of
its items' pieces, each an automaton of its own in a chained pass over the same
rows: so the broadcast is bounded, and the result is the same.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import keyed
from ._text import LOWER, Rolling, chunks, mix, word_bounds

WINDOW, SEGMENT = 10, 128
#: The bound on states of one automaton, and so on what is broadcast (about 160 MB); an item's word makes at most `window` states.
MOST_STATES = 4_000_000
#: Windows of a piece of an item.  Pieces are dealt, so that a benchmark of a single huge item is cut as well.
PIECE = 2_000
#: The bound on bytes of items in one automaton.
BLOCK_BYTES = 32 << 20
#: Bytes of words: letters, digits and all bytes of non-ASCII characters; the rest is a gap.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
_ITEM_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


class Automaton:
    """All windows of some items; a state is a prefix of a window, numbered by length, 0 the empty one."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        raw = b"".join(text for _, text in items)
        data = LOWER[np.frombuffer(raw, np.uint8)]
        off = np.concatenate([[0], np.cumsum([len(text) for _, text in items])]).astype(np.int64)
        starts, ends, item = word_bounds(data, off, IS_WORD)
        self.vocabulary, first, symbol = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        self.words = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        symbol = symbol + 1
        n = np.bincount(item, minlength=len(items))
        size = np.minimum(n, window)
        begin = np.flatnonzero(np.arange(len(symbol)) - (np.cumsum(n) - n)[item] <= (n - size)[item])  # where windows begin
        size = size[item[begin]]
        at = np.zeros(len(begin), np.int64)
        keys, parents, symbols, depth, levels = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int8)], [1]
        self.width = len(self.vocabulary) + 1
        for d in range(window):
            on = np.flatnonzero(size > d)
            if not len(on):
                break
            key, inverse = np.unique(at[on] * self.width + symbol[begin[on] + d], return_inverse=True)
            at[on] = levels[-1] + inverse
            keys.append(key)
            parents.append(key // self.width)
            symbols.append(key % self.width)
            depth.append(np.full(len(key), d + 1, np.int8))
            levels.append(levels[-1] + len(key))
        self.key, self.depth = np.concatenate(keys), np.concatenate(depth)
        self._fill_table()
        parent, symbol_of = np.concatenate(parents), np.concatenate(symbols)
        self.root = np.zeros(self.width, np.int32)
        if len(levels) > 1:
            self.root[symbol_of[1 : levels[1]]] = np.arange(1, levels[1])
        self.fail = np.zeros(len(self.key), np.int32)
        for lo, hi in zip(levels[1:], levels[2:], strict=False):
            self.fail[lo:hi] = self.step(self.fail[parent[lo:hi]], symbol_of[lo:hi])
        # the items whose window a state is, and the next shorter window that a state ends with
        own = np.unique(at * len(self.names) + np.array([number[name] for name, _ in items], np.int64)[item[begin]]) if len(begin) else np.zeros(0, np.int64)
        self.own_state, self.own_item = (own // len(self.names), own % len(self.names)) if len(begin) else (own, own)
        whole = np.zeros(len(self.key), bool)
        whole[at] = len(begin) > 0
        self.shorter = np.zeros(len(self.key), np.int32)
        for lo, hi in zip(levels, levels[1:], strict=False):
            f = self.fail[lo:hi]
            self.shorter[lo:hi] = np.where(whole[f], f, self.shorter[f])
        whole[0] = False
        self.whole, self.ends = whole, whole | (self.shorter > 0)

    @classmethod
    def of(cls, fields: dict) -> Automaton:
        """The automaton with these fields, which are not copied: workers get them alone, so that they need no module of this package."""
        own = cls.__new__(cls)
        own.__dict__ = fields
        return own

    def _fill_table(self) -> None:
        n = len(self.key)
        self.shift = np.uint64(64 - max(4, int(2 * n - 1).bit_length()))
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left = np.arange(1, n)
        slot = self._slot(self.key[left])
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> self.shift).astype(np.int64)

    def child(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state that a symbol leads to, or -1."""
        key = state.astype(np.int64) * self.width + symbol
        slot, out, left = self._slot(key), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(left):
            found = self.table[slot]
            hit = (found >= 0) & (self.key[found] == key[left])
            out[left[hit]] = found[hit]
            on = (found >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & (len(self.table) - 1)
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where symbols lead, by failure links if need be; symbol 0 leads to the empty state."""
        out = self.root[symbol].astype(np.int64)
        left = np.flatnonzero((state > 0) & (symbol > 0))
        at = state[left].astype(np.int64)
        while len(left):
            found = self.child(at, symbol[left])
            hit = found >= 0
            out[left[hit]] = found[hit]
            left, at = left[~hit], self.fail[at[~hit]].astype(np.int64)
            left, at = left[at > 0], at[at > 0]
        return out

    def scan(self, data: np.ndarray, off: np.ndarray):
        """Words of a chunk (starts, ends, document), and its hits: number of the last word, state, both by window that occurs."""
        low = LOWER[data]
        starts, ends, doc = word_bounds(low, off, IS_WORD)
        none = np.zeros(0, np.int64)
        if not len(starts) or len(self.key) == 1:
            return starts, ends, doc, none, none
        h = Rolling(low).of(starts, ends)
        symbol = np.searchsorted(self.vocabulary, h)
        symbol = np.where(self.vocabulary[np.minimum(symbol, len(self.vocabulary) - 1)] == h, symbol + 1, 0)
        n = np.bincount(doc, minlength=len(off) - 1)
        first = np.cumsum(n) - n
        parts = -(-n // SEGMENT)
        of = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        real = first[of] + part * SEGMENT  # where a segment's own words begin
        begin = np.maximum(real - (self.window - 1), first[of])
        size = np.minimum(real + SEGMENT, (first + n)[of]) - begin
        order = np.argsort(-size, kind="stable")
        begin, size, real = begin[order], size[order], real[order]
        state = np.zeros(len(begin), np.int64)
        at, found = [none], [none]
        for t in range(int(size[0])):
            k = int(np.searchsorted(-size, -t, "left"))  # segments that are longer than t
            here = begin[:k] + t
            state[:k] = self.step(state[:k], symbol[here])
            hit = np.flatnonzero(self.ends[state[:k]])
            hit = hit[here[hit] >= real[hit]]
            at.append(here[hit])
            found.append(state[hit])
        at, found = np.concatenate(at), np.concatenate(found)
        last, states = [none], [none]
        while len(at):
            own = self.whole[found]
            last.append(at[own])
            states.append(found[own])
            found = self.shorter[found].astype(np.int64)
            at, found = at[found > 0], found[found > 0]
        last, states = np.concatenate(last), np.concatenate(states)
        return starts, ends, doc, *self._same_words(low, starts, ends, symbol, last, states)

    def _same_words(self, low, starts, ends, symbol, last, states):
        """The hits whose words are the items' own and don't only share their hashes."""
        if not len(last):
            return last, states
        size = self.depth[states].astype(np.int64)
        words = np.unique(np.repeat(last - size + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        wrong = np.zeros(len(starts) + 1, np.int64)
        for w in words.tolist():
            wrong[w + 1] = low[starts[w] : ends[w]].tobytes() != self.words[symbol[w] - 1]
        wrong = np.cumsum(wrong)
        good = wrong[last + 1] == wrong[last + 1 - size]
        return last[good], states[good]

    def items_of(self, states: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) of hits."""
        lo, hi = np.searchsorted(self.own_state, states, "left"), np.searchsorted(self.own_state, states, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.repeat(doc, n) * max(1, len(self.names)) + self.own_item[at])
        return both // max(1, len(self.names)), both % max(1, len(self.names))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SCHEMA = "n_words long, n_hit long, items array<string>, words array<struct<start:int,end:int>>, chars array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_COLUMNS = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "words": _SPAN, "chars": _SPAN}


def _runs(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the runs of hit words within documents."""
    at = np.flatnonzero(hit)
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)]) if len(at) else np.zeros(0, bool)
    return at[new], at[np.concatenate([new[1:], [True]])] + 1 if len(at) else at


def _pass(automaton, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton.of(automaton.value)
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                starts, ends, doc, at, states = a.scan(data, off)
                n = np.bincount(doc, minlength=hi - lo)
                before = np.cumsum(n) - n
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, at - a.depth[states] + 1, 1)
                np.add.at(cover, at + 1, -1)
                own = [[] for _ in range(hi - lo)]
                for d, i in zip(*(x.tolist() for x in a.items_of(states, doc[at])), strict=True):
                    own[d].append(a.names[i])
                spans = [[] for _ in range(hi - lo)]
                for x, y in zip(*(x.tolist() for x in _runs(np.cumsum(cover)[:-1] > 0, doc)), strict=True):
                    spans[doc[x]].append((x - int(before[doc[x]]), y - int(before[doc[x]])))
                if not first:
                    for i, (names, words) in enumerate(zip(part.column("items").to_pylist(), part.column("words").to_pylist(), strict=True)):
                        own[i] = sorted({*own[i], *names})
                        spans[i] = merged([*spans[i], *((w["start"], w["end"]) for w in words)])
                chars = [[] for _ in range(hi - lo)]
                for i in (i for i in range(hi - lo) if spans[i] and last):
                    lead = np.concatenate([[0], np.cumsum((data[off[i] : off[i + 1]] & 0xC0) != 0x80)])
                    for x, y in spans[i]:
                        chars[i].append({"start": int(lead[starts[before[i] + x] - off[i]]), "end": int(lead[ends[before[i] + y - 1] - off[i]])})
                out = [n, [sum(y - x for x, y in s) for s in spans], own, [[{"start": x, "end": y} for x, y in s] for s in spans], chars]
                cols = [pa.array(c, k) for c, k in zip(out, _COLUMNS.values(), strict=True)]
                kept = [0] if last else [0, 1]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *cols], [*(("doc_id", "text")[i] for i in kept), *_COLUMNS])

    return run


def _automata(spark: SparkSession, benchmark: DataFrame, window: int, block_bytes: int, unnamed: bool = False) -> Iterator[tuple[int, int, object]]:
    """(number, count, broadcast fields of an automaton) of the parts of a benchmark; with `unnamed`, rows with a null item_id are items too, named ''."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.fillna("", "item_id") if unnamed else items.where("item_id is not null")
    words = F.regexp_extract_all("text", F.lit(_ITEM_WORD), F.lit(0))
    # pieces of PIECE windows, which overlap by less than a window: together they have the windows of their item and no other
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE)))
    items = items.withColumn("words", words).select("item_id", "words", at.alias("at")).select("item_id", "at", F.array_join(F.slice("words", F.col("at") + 1, PIECE + window - 1), " ").alias("text"))
    words = F.size(F.split("text", " "))
    total = items.agg(F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0)).alias("bytes")).first()
    over = 1 + (total["words"] * window > MOST_STATES or total["bytes"] > block_bytes) / 4  # a part takes a fifth less than the bound on average, for what hashes deal unevenly
    parts = max(1, math.ceil(over * total["words"] * window / MOST_STATES), math.ceil(over * total["bytes"] / block_bytes))
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "at", *(["text"] if unnamed else [])), F.lit(parts)) == k)
        yield k, parts, spark.sparkContext.broadcast(vars(Automaton([(r["item_id"], r["text"].encode()) for r in own.collect()], window)))  # bounded by both


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """The rows, with all their columns, in whose text no window occurs: no shuffle, and each row is judged by its own text.

    Null texts, and texts without words, stay; so do all rows where the benchmark is empty.  A null or repeated id changes nothing.
    Rows of the benchmark with a null item_id count with `unnamed` only.
    """
    at, names = docs.columns.index(text_col), docs.columns

    def one_pass(automaton):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = Automaton.of(automaton.value)
            for batch in batches:
                for lo, hi, data, off in chunks(batch.column(at)):
                    _, _, doc, last, _ = a.scan(data, off)
                    keep = np.ones(hi - lo, bool)
                    keep[doc[last]] = False
                    yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(names))], names).filter(pa.array(keep, pa.bool_()))

        return run

    out = docs
    for _, _, automaton in _automata(docs.sparkSession, benchmark, window, block_bytes, unnamed):
        out = out.mapInArrow(one_pass(automaton), docs.schema)
    return out


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items, hit ranges in words and in code points.

    Null texts have no words.  Items without words have no window; rows of the
    benchmark with a null item_id can't be named and are left out.  Repeated
    rows count once in an item, and once each among documents.  Other columns
    of either table are ignored.
    """
    out, kind = keyed(docs, id_col, text_col)
    for k, parts, automaton in _automata(spark, benchmark, window, block_bytes):
        last = k == parts - 1
        out = out.mapInArrow(_pass(automaton, k == 0, last), f"doc_id {kind}, " + ("" if last else "text string, ") + SCHEMA)
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and a digest of the items of `contamination`, row by row; no items give the digest of an empty text."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same result by comparing every window with every position; for tests."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda s: cut.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    parts = []
    for name, text in items:
        w = norm(text)
        size = min(window, len(w))
        parts += [(str(name), w[i : i + size]) for i in range(len(w) - size + 1)] if size and name is not None else []
    out = []
    for doc, text in docs:
        w, hit, own = norm(text), set(), set()
        for name, p in parts:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    own.add(name)
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out
