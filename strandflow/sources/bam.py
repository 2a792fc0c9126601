"""BAM as a Spark data source: BGZF blocks, records in Arrow batches, and partitions and regions from a .bai index.

An index says where records of a stretch of a contig begin, so that a contig is
cut into partitions of about `split_bytes` of the file, and a region is read
from its own places alone.  Filters on tid, pos and file_offset do the same.
Without an index partitions are ranges of bytes: each searches for the first
record that begins in it, and reads up to the first one of the next range, which
it searches too.  The first range begins behind the header; as each has to end
exactly where the next one begins, a false start can't go unseen.

The sink writes a part for each task, sorted by place, and joins the parts and
their index when all are done.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "file_offset long, qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, nm int, nn int, aln_score int, read_len int"
# Fixed values of the format.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _open(path: str):
    """A seekable file, of any file system that pyarrow knows."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


class Bgzf:
    """Reads from a virtual offset on (block start << 16 | place in the block)."""

    def __init__(self, f, offset: int = 0):
        self.f, self.next = f, offset >> 16
        self.block, self.data, self.at = self.next, b"", 0
        if offset & 0xFFFF:
            self._load()
            self.at = offset & 0xFFFF

    def _load(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(12)
        if len(head) < 12:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = self.f.read(struct.unpack_from("<H", head, 10)[0])
        size, i = None, 0
        while i + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, i + 2)[0]
            if extra[i : i + 2] == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError("a BGZF block without its size")
        raw = self.f.read(size - 12 - len(extra) - 8)
        self.block, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(raw, -15), 0
        return True

    def tell(self) -> int:
        if self.at >= len(self.data):
            return self.next << 16
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)


def header(f) -> tuple[list[tuple[str, int]], int]:
    """Contigs (name, length) and the virtual offset of the first record."""
    b = Bgzf(f)
    if b.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    b.read(struct.unpack("<i", b.read(4))[0])
    contigs = []
    for _ in range(struct.unpack("<i", b.read(4))[0]):
        name = b.read(struct.unpack("<i", b.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", b.read(4))[0]))
    return contigs, b.tell()


def _tags(raw: bytes) -> dict[str, int | None]:
    sizes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "A": "c"}
    out: dict[str, int | None] = {"NM": None, "nn": None, "AS": None}
    i = 0
    while i + 3 <= len(raw):
        tag, kind = raw[i : i + 2].decode(), chr(raw[i + 2])
        i += 3
        if kind in "ZH":
            i = raw.index(0, i) + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, i + 1)[0]
            i += 5 + n * struct.calcsize(sizes[chr(raw[i])])
        else:
            value = struct.unpack_from("<" + sizes[kind], raw, i)[0]
            i += struct.calcsize(sizes[kind])
            if tag in out:
                out[tag] = int(value) if kind not in "Af" else None
    return out


def records(b: Bgzf, end: int | None = None) -> Iterator[tuple]:
    while end is None or b.tell() < end:
        at = b.tell()
        head = b.read(4)
        if len(head) < 4:
            return
        raw = b.read(struct.unpack("<i", head)[0])
        tid, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
        i = 32 + n_name
        name = raw[32 : i - 1].decode()
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", raw, i))
        i += 4 * n_ops
        packed = raw[i : i + (n_seq + 1) // 2]
        seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:n_seq]
        tags = _tags(raw[i + (n_seq + 1) // 2 + n_seq :])
        yield at, name, flag, tid, pos, mapq, cigar, seq, tags["NM"], tags["nn"], tags["AS"], n_seq


#: Records in a row that have to make sense at a place before it counts as the first one of a range.
CHAIN = 4


def _block_size(raw: bytes, at: int) -> int | None:
    """Bytes of the BGZF block that begins at `at`, or None."""
    if raw[at : at + 4] != b"\x1f\x8b\x08\x04" or len(raw) < at + 18:
        return None
    i, end = at + 12, at + 12 + struct.unpack_from("<H", raw, at + 10)[0]
    while i + 4 <= min(end, len(raw)):
        n = struct.unpack_from("<H", raw, i + 2)[0]
        if raw[i : i + 2] == b"BC" and n == 2 and len(raw) >= i + 6:
            return struct.unpack_from("<H", raw, i + 4)[0] + 1
        i += 4 + n
    return None


def _whole_block(raw: bytes, at: int) -> bytes | None:
    """What the block at `at` holds, if its lengths and checksum fit; None if it isn't one."""
    size = _block_size(raw, at)
    if size is None or size < 26 or at + size > len(raw):
        return None
    try:
        data = zlib.decompress(raw[at + 12 + struct.unpack_from("<H", raw, at + 10)[0] : at + size - 8], -15)
    except zlib.error:
        return None
    return data if struct.unpack_from("<II", raw, at + size - 8) == (zlib.crc32(data), len(data)) else None


def _after(data: bytes, at: int, n_contigs: int) -> int | None:
    """Where the record at `at` ends, if its fields make sense; beyond the data if it goes on there; None if it is none."""
    if at + 36 > len(data):
        return len(data) + 1
    size, tid, pos, n_name, _, _, n_ops, _, n_seq, next_tid, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= tid < n_contigs and -1 <= next_tid < n_contigs and pos >= -1 and next_pos >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops]
    if any(ops[k] & 15 > 8 for k in range(0, len(ops), 4)):
        return None
    return at + 4 + size


def first_record(f, size: int, offset: int, n_contigs: int) -> int:
    """The virtual offset of the first record that begins in a block at or behind a byte of the file; the file's end if there is none."""
    step, at, raw = 1 << 17, offset, b""
    base = offset
    while True:  # the first block
        f.seek(base + len(raw))
        more = f.read(step)
        raw += more
        k = raw.find(b"\x1f\x8b\x08\x04", at - base)
        if k < 0:
            if not more:
                return size << 16
            base, raw = base + max(len(raw) - 3, 0), raw[-3:]
            at = base
            continue
        if len(raw) - k < 1 << 16 and more:
            continue
        if _whole_block(raw, k) is not None:
            at = base + k
            break
        at = base + k + 1
    room = 1 << 18
    while at < size:  # blocks from there on, until a record begins in one
        f.seek(at)
        raw, sizes, parts, k = f.read(room), [], [], 0
        while (n := _block_size(raw, k)) is not None and (part := _whole_block(raw, k)) is not None:
            sizes.append(len(part))
            parts.append(part)
            k += n
        if not sizes:
            raise ValueError("not a BGZF block")
        data, ended, unsure = b"".join(parts), at + k >= size, False
        for u in range(sizes[0]):
            end, seen = u, 0
            while end is not None and seen < CHAIN and end < len(data):
                end, seen = _after(data, end, n_contigs), seen + 1
            if end is not None and end > len(data) and not ended:
                unsure = True  # more of the file has to be seen
                break
            if end is not None and end <= len(data):
                return at << 16 | u
        if unsure:
            room *= 2
        else:
            at += _block_size(raw, 0)
    return size << 16


class Index:
    """A .bai file: by contig, the chunks of each bin, and the least offset of records that reach into each 16,384 bases."""

    def __init__(self, f):
        raw = f.read()
        if raw[:4] != b"BAI\1":
            raise ValueError("not a BAI file")
        at = 8
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.linear: list[tuple[int, ...]] = []
        for _ in range(struct.unpack_from("<i", raw, 4)[0]):
            own: dict[int, list[tuple[int, int]]] = {}
            n_bins = struct.unpack_from("<i", raw, at)[0]
            at += 4
            for _ in range(n_bins):
                number, n = struct.unpack_from("<Ii", raw, at)
                at += 8
                if number != TOTALS:
                    own[number] = [struct.unpack_from("<QQ", raw, at + 16 * k) for k in range(n)]
                at += 16 * n
            n = struct.unpack_from("<i", raw, at)[0]
            self.bins.append(own)
            self.linear.append(struct.unpack_from(f"<{n}Q", raw, at + 4))
            at += 4 + 8 * n

    def chunks(self, tid: int, beg: int = 0, end: int | None = None) -> list[tuple[int, int]]:
        """Chunks, in order, that may hold records of a stretch of a contig."""
        if not 0 <= tid < len(self.bins):
            return []
        found = sorted(c for number, own in self.bins[tid].items() if end is None or _reaches(number, beg, end) for c in own)
        least = self.linear[tid][min(beg >> 14, len(self.linear[tid]) - 1)] if self.linear[tid] else 0
        return [(a, b) for a, b in found if b > least]

    def parts(self, tid: int, split_bytes: int, beg: int = 0, end: int | None = None) -> list[tuple[int, int]]:
        """The same as disjoint ranges of about `split_bytes` of the file, cut where chunks begin."""
        out: list[list[int]] = []
        for a, b in self.chunks(tid, beg, end):
            if out and (a >> 16) - (out[-1][0] >> 16) < split_bytes:
                out[-1][1] = max(out[-1][1], b)
            else:  # chunks of nested bins overlap
                before = out[-1][1] if out else 0
                if before > a:
                    out[-1][1] = a
                out.append([a, max(b, before)])
        return [(a, b) for a, b in out]


# The bin of totals, and the tree of bins as (first number, bits of a bin's width).
TOTALS, LEVELS = 37450, ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))


def _reaches(number: int, beg: int, end: int) -> bool:
    first, bits = next(x for x in reversed(LEVELS) if number >= x[0])
    return (number - first) << bits < end and (number - first + 1) << bits > beg


_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
BATCH = 2_048


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for row in rows:
        some.append(row)
        if len(some) == BATCH:
            yield batch()
            some = []
    if some:
        yield batch()


def _span(cigar: str) -> int:
    return max(1, sum(int(n) for n, _ in re.findall(r"([0-9]+)([MDN=X])", cigar)))


class _Part(InputPartition):
    def __init__(self, path: str, tid: int | None, start: int, end: int | None, search: bool = False):
        self.path, self.tid, self.start, self.end = path, tid, start, end
        self.search = search  # start (but for that of the first range) and end are bytes of the file, and not places of records


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        number = lambda name: int(options[name]) if options.get(name) else None
        self.path, self.index = options["path"], options.get("index")
        self.tids = None if number("tid") is None else {number("tid")}
        self.beg, self.stop = number("beg") or 0, number("end")
        self.split = number("split_bytes") or 32 << 20
        self.least, self.most = 0, None  # virtual offsets

    def pushFilters(self, filters):
        """Places narrow what is read; all filters are checked by Spark again."""
        for x in filters:
            name, value = getattr(x, "attribute", None), getattr(x, "value", None)
            above, below = isinstance(x, GreaterThan | GreaterThanOrEqual | EqualTo), isinstance(x, LessThan | LessThanOrEqual | EqualTo)
            if name == ("tid",) and isinstance(x, EqualTo | In) and value is not None:
                found = {value} if isinstance(x, EqualTo) else set(value)
                self.tids = found if self.tids is None else self.tids & found
            elif name == ("pos",) and value is not None:
                self.beg = max(self.beg, value) if above else self.beg
                self.stop = min(self.stop if self.stop is not None else value + 1, value + 1) if below else self.stop
            elif name == ("file_offset",) and value is not None:
                self.least = max(self.least, value) if above else self.least
                self.most = min(self.most if self.most is not None else value, value) if below else self.most
            yield x

    def partitions(self):
        none = [_Part(self.path, -2, 0, 0)]  # Spark wants one
        if not self.index:
            with _open(self.path) as f:
                start, size = header(f)[1], f.size()
            lows = range(start >> 16, size, self.split)
            return [_Part(self.path, None, start if k == 0 else lo, lo + self.split if k + 1 < len(lows) else None, True) for k, lo in enumerate(lows)] or none
        with _open(self.index) as f:
            index = Index(f)
        tids = [t for t in range(len(index.bins)) if self.tids is None or t in self.tids]
        ranges = [(tid, *r) for tid in tids for r in index.parts(tid, self.split, self.beg, self.stop)]
        return [_Part(self.path, tid, a, b) for tid, a, b in ranges if b > self.least and (self.most is None or a <= self.most)] or none

    def read(self, part):
        if part.end == 0:
            return
        with _open(part.path) as f:
            if part.search:
                contigs, first = header(f)
                start = part.start if part.start == first else first_record(f, f.size(), part.start, len(contigs))
                end = None if part.end is None else first_record(f, f.size(), part.end, len(contigs))
            else:
                start, end = part.start, part.end
            b = Bgzf(f, start)
            rows = (r for r in records(b, end) if (part.tid is None or r[3] == part.tid) and (self.tids is None or r[3] in self.tids))
            if self.beg or self.stop is not None:
                rows = (r for r in rows if (self.stop is None or r[4] < self.stop) and r[4] + _span(r[6]) > self.beg)
            yield from _batches(rows)
            if part.search and end is not None and b.tell() != max(start, end) and end >> 16 < f.size():
                raise ValueError(f"the range of the file from byte {part.start} on doesn't end where the next one begins; read it with its index or as one partition")


def _encoded(r: dict) -> tuple[bytes, int]:
    """A record's bytes, and how many bases of the reference it spans."""
    parts = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
    codes = [BASES.index(c) for c in r["seq"]] + [0] * (len(r["seq"]) % 2)
    span = max(1, sum(n for n, o in parts if OPS[o] in "MDN=X"))
    body = struct.pack("<iiBBHHHiiii", r["tid"], r["pos"], len(r["qname"]) + 1, r["mapq"], _bin(r["pos"], r["pos"] + span), len(parts), r["flag"], len(r["seq"]), -1, -1, 0)
    body += r["qname"].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in parts)
    body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + b"\xff" * len(r["seq"])
    body += b"".join(tag.encode() + b"i" + struct.pack("<i", r[key]) for tag, key in (("NM", "nm"), ("nn", "nn"), ("AS", "aln_score")) if r.get(key) is not None)
    return struct.pack("<i", len(body)) + body, span


class _Packer:
    """BGZF blocks to a file; `tell` is the virtual offset of the next byte."""

    def __init__(self, f, block: int = 48_000):
        self.f, self.block, self.written, self.pending = f, block, 0, bytearray()

    def tell(self) -> int:
        return self.written << 16 | len(self.pending)

    def write(self, raw: bytes) -> None:
        self.pending += raw
        while len(self.pending) >= self.block:
            self.flush()

    def flush(self) -> None:
        part = bytes(self.pending[: self.block])
        del self.pending[: self.block]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        whole = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        self.f.write(whole)
        self.written += len(whole)

    def close(self) -> None:
        while self.pending:
            self.flush()


def _head(contig_rows: list[tuple[str, int]]) -> bytes:
    return b"BAM\1" + struct.pack("<ii", 0, len(contig_rows)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contig_rows)


class _Bins:
    """What a .bai says of records in their order: chunks of bins, of which neighbours are one, and the least offset for each 16,384 bases."""

    def __init__(self) -> None:
        self.chunks: dict[int, dict[int, list[list[int]]]] = {}
        self.linear: dict[int, dict[int, int]] = {}

    def add(self, tid: int, pos: int, span: int, start: int, end: int) -> None:
        if tid < 0:
            return
        own = self.chunks.setdefault(tid, {}).setdefault(_bin(pos, pos + span), [])
        if own and own[-1][1] == start:
            own[-1][1] = end
        else:
            own.append([start, end])
        least = self.linear.setdefault(tid, {})
        for w in range(pos >> 14, (pos + span - 1 >> 14) + 1):
            least[w] = min(least.get(w, start), start)

    def join(self, other: _Bins, shift: int) -> None:
        """What follows: another part's, which begins at a byte of the file."""
        for tid, bins in other.chunks.items():
            for number, spans in bins.items():
                self.chunks.setdefault(tid, {}).setdefault(number, []).extend([a + (shift << 16), b + (shift << 16)] for a, b in spans)
        for tid, least in other.linear.items():
            own = self.linear.setdefault(tid, {})
            for w, x in least.items():
                own[w] = min(own.get(w, x + (shift << 16)), x + (shift << 16))

    def raw(self, n_contigs: int) -> bytes:
        out = bytearray(b"BAI\1" + struct.pack("<i", n_contigs))
        for tid in range(n_contigs):
            bins, least = self.chunks.get(tid, {}), self.linear.get(tid, {})
            out += struct.pack("<i", len(bins))
            for number, spans in sorted(bins.items()):
                out += struct.pack("<Ii", number, len(spans)) + b"".join(struct.pack("<QQ", *x) for x in spans)
            out += struct.pack("<i", max(least, default=-1) + 1)
            before = 0
            for w in range(max(least, default=-1) + 1):
                before = least.get(w, before)
                out += struct.pack("<Q", before)
        return bytes(out)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    size: int
    first: tuple[bool, int, int]
    last: tuple[bool, int, int]
    bins: _Bins


def _place(tid: int, pos: int) -> tuple[bool, int, int]:
    return tid < 0, tid, pos


class _Writer(DataSourceWriter):
    """A task writes its records to a part; the commit writes the header, the parts in their order, and one index."""

    def __init__(self, options: dict):
        self.path, self.index = options["path"], options.get("index")
        self.contigs = [(n, int(size)) for n, size in json.loads(options["contigs"])]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        system, where = self._system()
        folder = where + self.parts[len(self.path) :]
        system.create_dir(folder)
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # an attempt of its own, which no other one overwrites
        bins, first, last = _Bins(), None, None
        with system.open_output_stream(name) as f:
            packer = _Packer(f)
            for row in iterator:
                at = _place(row["tid"], row["pos"])
                if last is not None and at < last:
                    raise ValueError("records of a task aren't sorted by place")
                first, last = first or at, at
                raw, span = _encoded(row.asDict())
                start = packer.tell()
                packer.write(raw)
                bins.add(row["tid"], row["pos"], span, start, packer.tell())
            packer.close()
        return _Written(name, packer.written, first, last, bins) if first else _Written(name, 0, (True, 0, 0), (True, 0, 0), bins)

    def commit(self, messages):
        system, where = self._system()
        done = sorted((m for m in messages if m is not None and m.size), key=lambda m: m.first)
        if any(a.last > b.first for a, b in zip(done, done[1:], strict=False)):
            raise ValueError("the parts overlap: deal records by ranges of their place")
        bins = _Bins()
        with system.open_output_stream(where) as out:
            packer = _Packer(out)
            packer.write(_head(self.contigs))
            packer.close()
            at = packer.written
            for m in done:
                bins.join(m.bins, at)
                with system.open_input_stream(m.path) as part:
                    while raw := part.read(8 << 20):  # some bytes at a time
                        out.write(raw)
                at += m.size
            out.write(EOF_BLOCK)
        if self.index:
            target = where[: len(where) - len(self.path)] + self.index if "://" not in self.index else type(system).from_uri(self.index)[1]
            with system.open_output_stream(target) as f:
                f.write(bins.raw(len(self.contigs)))
        self._drop()

    def abort(self, messages):
        self._drop()

    def _drop(self) -> None:
        system, where = self._system()
        folder = where + self.parts[len(self.path) :]
        from pyarrow import fs

        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def read_bam(spark: SparkSession, path: str, index: str | None = None, tid: int | None = None, beg: int | None = None, end: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """All records, those of a contig, or with `beg` and `end` those that overlap a stretch of it.

    Partitions are ranges of the file, with or without an index; unplaced records
    need a read without.  Filters on tid, pos and file_offset reach the source,
    for which a setting of the session has to be on, and stays on.
    """
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("bam").option("path", path)
    for name, value in (("index", index), ("tid", tid), ("beg", beg), ("end", end), ("split_bytes", split_bytes)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()


def fetch(offsets: DataFrame, path: str, offset: str = "file_offset") -> DataFrame:
    """The records at the given offsets, one for each row; rows are dealt by ranges, so that a task reads on in one part of the file.  Null offsets give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            with _open(path) as f:
                b, known = None, {}
                for batch in batches:
                    for at in batch.column(0).to_pylist():
                        if b is None or b.block != at >> 16:
                            b = Bgzf(f, at)
                        else:
                            b.at = at & 0xFFFF  # the same block is still there
                        if at not in known:
                            known = {at: next(records(b))}
                        yield known[at]

        yield from _batches(rows())

    return offsets.where(F.col(offset).isNotNull()).select(F.col(offset).cast("long").alias("o")).repartitionByRange("o").sortWithinPartitions("o").mapInArrow(run, SCHEMA)


def contigs(spark: SparkSession, path: str) -> DataFrame:
    with _open(path) as f:
        rows, _ = header(f)
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(rows)], "tid int, name string, length int")


def _bin(start: int, end: int) -> int:
    """The smallest bin of the format's tree that holds a range."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def save_bam(df: DataFrame, path: str, contig_rows: list[tuple[str, int]], index: str | None = None) -> None:
    """Write records (the columns of SCHEMA but file_offset and read_len) to one BAM file, sorted by place, and its index.

    Tasks write the parts.  They are dealt by ranges of (tid, pos), unplaced
    records last; the driver copies the parts' bytes together, some at a time.
    """
    df.sparkSession.dataSource.register(BamSource)
    columns = ("qname", "flag", "tid", "pos", "mapq", "cigar", "seq", "nm", "nn", "aln_score")
    order = (F.col("tid") < 0, F.col("tid"), F.col("pos"))
    rows = df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order, "qname")
    options = {"path": path, "contigs": json.dumps(contig_rows), **({"index": index} if index else {})}
    rows.write.format("bam").mode("append").options(**options).save()


def write_bam(path: str, contig_rows: list[tuple[str, int]], rows: list[dict], index: str | None = None, block: int = 48_000) -> None:
    """Write a few records (sorted by tid and pos here) to a local BAM file, for tests; `save_bam` writes frames."""
    bins = _Bins()
    with open(path, "wb") as f:
        packer = _Packer(f, block)
        packer.write(_head(contig_rows))
        packer.close()
        for r in sorted(rows, key=lambda r: _place(r["tid"], r["pos"])):
            raw, span = _encoded(r)
            start = packer.tell()
            packer.write(raw)
            bins.add(r["tid"], r["pos"], span, start, packer.tell())
        packer.close()
        f.write(EOF_BLOCK)
    if index:
        with open(index, "wb") as f:
            f.write(bins.raw(len(contig_rows)))
