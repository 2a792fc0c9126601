"""Token counts of a byte-level BPE without materialising the ids of any document.

Pieces never cross a pre-token, so a document's count is the sum over its
distinct pre-tokens of frequency times pieces.  A task holds a table of the
distinct pre-tokens that it has met, each counted once by the tokenizer's own
library, and joins it to each document's frequencies.  The join is local to
the task: a shuffled join over the corpus would move a row for each distinct
pre-token of each document (two thirds of all tokens, more bytes than the
input), and its commonest keys would be hot.

The table is bounded: at `table_size` entries it starts anew, which costs time
and changes no count.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 250_000
#: White space as Unicode has it, which is what the tokenizers library takes for \s.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed pattern of byte-level BPE: contractions, letters, numbers, other signs, space at a run's end, space.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class PieceCounter:
    """Counts for one tokenizer file; special strings in a text are special tokens, as is the library's default."""

    def __init__(self, path: str, table_size: int = TABLE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(PRETOKEN).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))).split if special else lambda s: [s]
        self.special = tuple(special)
        self.table: dict[str, int] = {}
        self.table_size = table_size

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 10_000):
            some = words[i : i + 10_000]
            self.table.update(zip(some, (len(e) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts = self.split(text) if any(s in text for s in self.special) else [text]
            n = len(parts) - 1
            for part in parts:
                freq = Counter(self.find(part))
                new = [w for w in freq if w not in self.table]
                if len(self.table) + len(new) > self.table_size:
                    self.table = {}
                    new = list(freq)
                self.learn(new)
                n += sum(map(int.__mul__, freq.values(), map(self.table.__getitem__, freq)))
            out.append(n)
        return out


def _count(path: str, table_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or PieceCounter(path, table_size)
            n = [counter.count([t.as_py() or ""])[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, table_size: int = TABLE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null texts count as empty: no bytes, no tokens.  Repeated rows are counted
    each, long texts whole; exactly `limit` tokens aren't over it; an empty table
    gives no rows.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(_count(tokenizer_path, table_size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
