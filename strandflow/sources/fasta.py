"""FASTA by range: a Spark data source whose partitions are byte ranges of contigs, computed from the .fai index.

The index says how many bases and bytes a line has, so that base x of a contig
lies at a known byte.  A partition seeks to its bases and reads them alone; no
row, task or driver holds a contig.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import _open

SCHEMA = "name string, ordinal int, tile int, offset int, seq string"
_ARROW = pa.schema([("name", pa.string()), ("ordinal", pa.int32()), ("tile", pa.int32()), ("offset", pa.int32()), ("seq", pa.string())])
SPLIT = 8 << 20


@dataclass(frozen=True)
class Contig:
    """A line of a .fai: bases, the byte of the first one, and bases and bytes of a line."""

    name: str
    ordinal: int
    length: int
    start: int
    line_bases: int
    line_bytes: int

    def byte(self, base: int) -> int:
        return self.start + base // self.line_bases * self.line_bytes + base % self.line_bases if self.line_bases else self.start


def read_index(path: str) -> list[Contig]:
    """The contigs of a .fai, in its order; a line that makes no sense raises ValueError."""
    with _open(path) as f:
        lines = f.read().decode().splitlines()
    out = []
    for line in lines:
        if not line.strip():
            continue
        cells = line.split("\t")
        try:
            name, (length, start, bases, width) = cells[0], (int(x) for x in cells[1:5])
        except (ValueError, IndexError):
            raise ValueError(f"not a line of a FASTA index: {line!r}") from None
        if length < 0 or start < 0 or length and not 0 < bases <= width:
            raise ValueError(f"not a line of a FASTA index: {line!r}")
        out.append(Contig(name, len(out), length, start, bases, width))
    return out


class _Part(InputPartition):
    def __init__(self, pieces: list[tuple[Contig, int, int]]):
        self.pieces = pieces  # contig, first tile, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index = options["path"], options.get("index") or options["path"] + ".fai"
        self.size, self.overlap, self.split = (int(options.get(k, d)) for k, d in (("tile", 65_536), ("overlap", 2_000), ("split", SPLIT)))

    def partitions(self):
        """Tiles in the order of the file, gathered to about `split` bases a partition; a small contig shares one with its neighbours."""
        parts: list[list] = [[]]
        room = self.split
        for c in read_index(self.index):
            tiles, at = max(1, -(-c.length // self.size)), 0
            while at < tiles:
                n = max(1, min(tiles - at, room // self.size))
                parts[-1].append((c, at, at + n))
                at, room = at + n, room - n * self.size
                if room <= 0:
                    parts.append([])
                    room = self.split
        return [_Part(p) for p in parts if p]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            for c, first, end in part.pieces:
                lo, hi = first * self.size, min(end * self.size + self.overlap, c.length)
                f.seek(c.byte(lo))
                raw = f.read(c.byte(hi) - c.byte(lo)) if hi > lo else b""
                bases = raw.translate(None, b"\r\n").upper()
                if len(bases) < hi - lo or b">" in bases:
                    raise ValueError(f"the index doesn't fit the file at contig {c.name}")
                bases = bases[: hi - lo]
                rows = [(c.name, c.ordinal, k, k * self.size, bases[k * self.size - lo :][: self.size + self.overlap].decode()) for k in range(first, end)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_tiles(spark: SparkSession, path: str, index: str | None = None, size: int = 65_536, overlap: int = 2_000, split: int = SPLIT) -> DataFrame:
    """name, ordinal, tile, offset, seq (upper case): overlapping tiles of all contigs of an indexed FASTA file; an empty contig is one empty tile."""
    spark.dataSource.register(FastaSource)
    options = {"path": path, "tile": size, "overlap": overlap, "split": split, **({"index": index} if index else {})}
    return spark.read.format("fasta_tiles").options(**options).load()
