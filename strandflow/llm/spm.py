"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is split where white space begins (no piece continues over such a
place), and distinct words are segmented once.  All substrings of a block of
words are hashed from prefix sums, and their hashes probe the sorted piece keys
of their length.  Words of equal length then advance together, position by
position; vectorised maxima store backpointers.

The vocabulary file is read as it is.  Of a unigram file the scores are its
own; a BPE file holds merge ranks in their place, whose sum means nothing, so
that -log(2 + rank) stands for a piece's log probability (Zipf's law).  With
scores="file" the file's numbers are used whatever its kind.
Characters without a piece become byte pieces, and so does a literal U+2581,
so that decoding gives back exactly the text that was encoded.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keyed
from ._text import Rolling, chunks, mix

GAP = "▁"
WORD = re.compile(f"{GAP}*[^{GAP}]+|{GAP}+")
CACHE_WORDS, BLOCK_CHARS, TEXT_BYTES = 150_000, 100_000, 2 << 20
FILTER_BITS = 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the file format
UNIGRAM, BPE = 1, 2  # fixed values: model types of the file format


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + n]
            at += n


def _slot(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - FILTER_BITS)


class Vocabulary:
    def __init__(self, path: str, scores: str = "auto"):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.types: list[int] = []
        file_scores: list[float] = []
        self.kind = UNIGRAM
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                file_scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
        types = np.array(self.types)
        score = np.array(file_scores, np.float32)
        if scores == "auto" and self.kind == BPE:
            score = -np.log(2 + np.clip(-score, 0, len(score))).astype(np.float32)
        self.scores = score
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces, so decoding could lose text")
        self.unknown = np.float32(score[types == NORMAL].min() - np.float32(10)) if (types == NORMAL).any() else np.float32(-1e9)
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.split_words = not any(GAP in self.pieces[i].lstrip(GAP) for i in usable)
        self.keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool))]
        for size in range(1, self.longest + 1):
            some = [i for i in usable if len(self.pieces[i]) == size]
            codes = np.frombuffer("".join(self.pieces[i] for i in some).encode("utf-32-le"), np.uint32)
            h = mix(Rolling(codes).every(size)[::size]) if some else np.zeros(0, np.uint64)
            order = np.argsort(h)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[_slot(h)] = True
            self.keys.append((h[order], np.array(some, np.int32)[order], seen))
        self.bytes_of = [p.replace(GAP, " ").encode() if t in (NORMAL, USER) else b"" for p, t in zip(self.pieces, self.types, strict=True)]
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])

    def _probe(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """found[size, p]: the piece that starts at p with so many characters, or -1."""
        n = len(codes)
        rolling = Rolling(codes)
        found = np.full((self.longest + 1, n), -1, np.int32)
        for size in range(1, min(self.longest, n) + 1):
            keys, ids, seen = self.keys[size]
            if not len(keys):
                continue
            h = mix(rolling.every(size))
            at = np.flatnonzero(seen[_slot(h)] & (np.arange(size, n + 1) <= ends[: n - size + 1]))
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[k] == h[at]
            found[size, at[hit]] = ids[k[hit]]
        return found

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word (characters as in the text, gaps as U+2581)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lo = 0
        while lo < len(words):
            hi, total = lo, 0
            while hi < len(words) and (hi == lo or total + len(words[hi]) <= BLOCK_CHARS):
                total += len(words[hi])
                hi += 1
            self._block(words, lo, hi, out)
            lo = hi
        return out

    def _block(self, words: list[str], lo: int, hi: int, out: list[np.ndarray]) -> None:
        sizes = np.array([len(w) for w in words[lo:hi]])
        codes = np.frombuffer("".join(words[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found = self._probe(codes, np.repeat(ends, sizes))
        gain = np.where(found >= 0, self.scores[found], np.float32(-np.inf)).astype(np.float32)
        gain[1][found[1] < 0] = self.unknown
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if size > 512:  # too few of equal length to advance together
                for r in rows:
                    out[lo + r] = self._ids(codes, starts[r], size, found, self._single(gain, int(starts[r]), size))
                continue
            s, every = starts[rows], np.arange(len(rows))
            best = np.zeros((size + 1, len(rows)), np.float32)
            back = np.zeros((size + 1, len(rows)), np.int32)
            for end in range(1, size + 1):
                width = np.arange(min(end, self.longest), 0, -1)  # of equal scores the longest last piece holds
                score = gain[width[:, None], s + (end - width)[:, None]] + best[end - width[0] : end]
                pick = score.argmax(0)
                best[end] = score[pick, every]
                back[end] = width[pick]
            # the way back, for all words at once: pieces by step, the last one first
            end, steps, odd = np.full(len(rows), size), [], np.zeros(len(rows), bool)
            while (on := end > 0).any():
                width = np.where(on, back[end, every], 0)
                end = end - width
                piece = np.where(on, found[width, np.minimum(s + end, len(codes) - 1)], -2)
                odd |= piece == -1
                steps.append(piece)
            grid = np.stack(steps[::-1], 1).astype(np.int32)
            flat = grid[grid != -2]
            ends_of = np.cumsum((grid != -2).sum(1)).tolist()
            first = 0
            for j, r in enumerate(rows.tolist()):
                out[lo + r] = flat[first : ends_of[j]]
                first = ends_of[j]
            for j in np.flatnonzero(odd).tolist():  # characters without a piece are spelled in bytes
                r = rows[j]
                out[lo + r] = self._ids(codes, starts[r], size, found, back[:, j])

    def _single(self, gain: np.ndarray, start: int, size: int) -> np.ndarray:
        best = np.zeros(size + 1, np.float32)
        back = np.zeros(size + 1, np.int32)
        wide = np.arange(self.longest, 0, -1)
        for end in range(1, size + 1):
            width = wide[-min(end, self.longest) :]
            score = gain[width, start + end - width] + best[end - width]
            k = int(score.argmax())
            best[end], back[end] = score[k], width[k]
        return back

    def _ids(self, codes: np.ndarray, start: int, size: int, found: np.ndarray, back: np.ndarray) -> np.ndarray:
        ids: list[int] = []
        end = size
        while end:
            width = int(back[end])
            piece = int(found[width, start + end - width])
            if piece >= 0:
                ids.append(piece)
            else:
                code = int(codes[start + end - 1])
                ids += [self.byte[b] for b in reversed(chr(LITERAL if code == STAND_IN else code).encode())]
            end -= width
        return np.array(ids[::-1], np.int32)

    def decode(self, ids) -> str:
        try:
            raw = b"".join([self.bytes_of[i] for i in ids])
        except (IndexError, TypeError):  # such an id, or a null one
            raw = b"".join([self.bytes_of[i] if i is not None and 0 <= i < len(self.bytes_of) else "\ufffd".encode() for i in ids])
        return raw.decode("utf-8", "replace")[1:]


#: A literal U+2581 of the text is carried as a lone surrogate, which no UTF-8 text holds and no piece has.
LITERAL, STAND_IN = 0x2581, 0xD800


class Encoder:
    """Encodes texts with a bounded table of words that were segmented before."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.vocabulary, self.cache_words = vocabulary, cache_words
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        shown = GAP + text.replace(GAP, chr(STAND_IN)).replace(" ", GAP)
        return WORD.findall(shown) if self.vocabulary.split_words else [shown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.cache})
        if len(self.cache) + len(new) > self.cache_words:
            self.cache = {}
            new = list({w for words in split for w in words})
        self.cache.update(zip(new, (ids.tobytes() for ids in self.vocabulary.segment(new)), strict=True))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]


def _batches(model_path: str, scores: str, ids: bool, digests: bool, keep_nulls: bool = False):
    """doc_id and, as asked for, ids and the digests of `digest`, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(model_path, scores))
            for lo, hi, _, _ in chunks(batch.column(1), TEXT_BYTES):
                own = batch.column(1).slice(lo, hi - lo)
                texts = [t or "" for t in own.to_pylist()]
                found = encoder.encode(texts)
                cols = {"doc_id": batch.column(0).slice(lo, hi - lo)}
                if ids:
                    offs = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])), mask=own.is_null() if keep_nulls and own.null_count else None)
                    cols["ids"] = lists
                if digests:
                    back = [encoder.vocabulary.decode(x.tolist()) for x in found]
                    cols |= {
                        "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found]), "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)]),
                    }
                yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])

    return run


DIGEST = "n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encoded(docs: DataFrame, model_path: str, scores: str = "auto", id_col: str = "doc_id", text_col: str = "text", digests: bool = False, keep_nulls: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids, and with `digests` the columns of `digest`.

    Null and empty texts have no ids; with `keep_nulls` a null text has null, which `decoded` gives back.  Very long texts are a chunk
    of their own.  Repeated rows are encoded each; other columns are ignored.
    """
    rows, kind = keyed(docs, id_col, text_col)
    return rows.mapInArrow(_batches(model_path, scores, True, digests, keep_nulls), f"doc_id {kind}, ids array<int>" + f", {DIGEST}" * digests)


def decoded(ids: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text; null ids give null.  An id that the vocabulary doesn't have stands for U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(model_path)
            texts = [None if not x.is_valid else vocabulary.decode(x.values.to_pylist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, model_path: str, scores: str = "auto", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_sha256 (little-endian int32), decoded_sha256 and whether the text came back; a null text counts as empty.

    Repeated rows are encoded each, long texts whole; an empty table gives no
    rows.  Other columns are ignored.
    """
    rows, kind = keyed(docs, id_col, text_col)
    return rows.mapInArrow(_batches(model_path, scores, False, True), f"doc_id {kind}, {DIGEST}")
