"""Chat formatting over a prefix tree of conversations.

Conversations that begin with the same turns share them: a node is a turn after
given turns, and its tokens are emitted once.  A pack is a part of the tree in
depth-first order, written as one run of tokens; each node has its place there,
the position id of its first token in its own conversation, and the intervals
of its ancestors, which with causal attention within the node are all that its
tokens may attend to.

Scale.  Rows of one conversation that stand near each other are compressed to
one value before they are dealt by conv_id, and whole conversations travel
compressed to their pack, so that the text is shuffled twice but in less than
its size in Parquet.  A conversation's path is the sequence of hashes of its
prefixes, so that the order of paths is depth-first order.  Paths are
range-partitioned together with the task that they come from; of equal
conversations in a task only the first carries its text.  So neither a first
turn nor a conversation that a third of all rows share lies in one task.  A
range opens a new pack after `pack_tokens` tokens, or after many leaves, and
repeats there the ancestors that it needs.  Ancestors that lie next to each
other are one interval, which makes a deep conversation's list short.  One
conversation, and the rows without a conv_id, have to fit in a task, since a
digest of turns is sequential anyway.

The template is "### role: text </turn>" and a line end.  Backslashes in texts
are doubled, and one is put before "###" and "</turn>", which is undone exactly
by `unescape`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pack is closed after so many tokens, or so many bytes of paths of its leaves.
PACK_TOKENS, PACK_PATHS = 1 << 18, 1 << 22
#: Bytes of a prefix's hash.
KEY = 12
#: Paths that a task remembers; it starts anew beyond, and repeats texts.
SEEN_BYTES = 1 << 24
OPEN, CLOSE = "### ", " </turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?) </turn>\n", re.S)
_UNESCAPE = re.compile(r"\\([\\#<:])")

_NODE = pa.struct([
    ("node", pa.int32()), ("parent", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()),
    ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("ancestors", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
PACK_SCHEMA = (
    "tokens array<int>, nodes array<struct<node:int,parent:int,start:bigint,end:bigint,position:bigint,loss_start:bigint,loss_end:bigint,"
    "ancestors:array<struct<start:bigint,end:bigint>>>>, leaves array<struct<conv_id:{},path:binary,node:int>>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text lies in it."""
    head = f"{OPEN}{escape_role(role)}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def _pressed(turns: list) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(json.dumps(turns, ensure_ascii=False).encode())


def _unpressed(raw: bytes) -> list:
    import zstandard

    return json.loads(zstandard.ZstdDecompressor().decompress(raw))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each conversation of a batch in one value."""
    for batch in batches:
        ids = batch.column(0).dictionary_encode()
        own: dict[int | None, list] = {}
        for key, *row in zip(ids.indices.to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            own.setdefault(key, []).append(row)
        if own:
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(list(own), pa.int32())), pa.array([_pressed(t) for t in own.values()], pa.binary())], ["conv_id", "turns"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From values by conv_id the conversations: turns in order, and the path of their prefixes' hashes."""

    def done(key, parts: list[bytes]):
        rows = [row for raw in parts for row in _unpressed(raw)]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        last, path = b"", []
        for _, role, text in rows:
            last = hashlib.blake2b(b"%b%d|%b%b" % (last, len(role), role.encode(), text.encode()), digest_size=KEY).digest()
            path.append(last)
        return key, b"".join(path), _pressed([r[1:] for r in rows])

    key, parts = None, []
    for batch in batches:
        out = []
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if parts and k != key:
                out.append(done(key, parts))
                parts = []
            key = k
            parts.append(raw)
        if out:
            yield _columns(out, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    if parts:
        yield _columns([done(key, parts)], kind)


def _columns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (kind, pa.binary(), pa.binary()), strict=True)], ["conv_id", "path", "turns"])


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, path, turns (compressed roles and texts): one row for each conversation, in order of turn, role and text.

    Null roles and texts count as empty; null turns come first; rows without a
    conv_id are one conversation; repeated rows are turns each.  Other columns
    are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    kind = own.schema["conv_id"].dataType.simpleString()
    dealt = own.mapInArrow(_gather, f"conv_id {kind}, turns binary").repartition("conv_id").sortWithinPartitions("conv_id")
    return dealt.mapInArrow(_whole, f"conv_id {kind}, path binary, turns binary")


class _Pack:
    def __init__(self):
        self.tokens: list[str] = []
        self.size = self.paths = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []

    def add(self, parent: dict | None, role: str, text: str) -> dict:
        piece, a, b = segment(role, text)
        start, at, above = self.size, 0, []
        if parent is not None:
            at = parent["position"] + parent["end"] - parent["start"]
            above = list(parent["ancestors"])
            if above and above[-1]["end"] == parent["start"]:
                above[-1] = {"start": above[-1]["start"], "end": parent["end"]}
            else:
                above.append({"start": parent["start"], "end": parent["end"]})
        loss = role == "assistant"
        node = {
            "node": len(self.nodes), "parent": -1 if parent is None else parent["node"], "start": start, "end": start + len(piece), "position": at,
            "loss_start": start + (a if loss else 0), "loss_end": start + (b if loss else 0), "ancestors": above,
        }
        self.tokens.append(piece)
        self.size += len(piece)
        self.nodes.append(node)
        return node

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        codes = np.frombuffer("".join(self.tokens).encode("utf-32-le"), np.int32)
        tokens = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(codes))
        leaf = pa.struct([("conv_id", kind), ("path", pa.binary()), ("node", pa.int32())])
        return pa.RecordBatch.from_arrays([tokens, pa.array([self.nodes], pa.list_(_NODE)), pa.array([self.leaves], pa.list_(leaf))], ["tokens", "nodes", "leaves"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the conversations of a task that are equal, one with its turns and the rest without."""
    seen, size = set(), 0
    task = TaskContext.get().partitionId()
    for batch in batches:
        again = []
        for path in batch.column("path").to_pylist():
            again.append(path in seen)
            if not again[-1]:
                if size > SEEN_BYTES:
                    seen, size = set(), 0
                seen.add(path)
                size += len(path) + 64
        turns = pc.if_else(pa.array(again, pa.bool_()), pa.scalar(None, pa.binary()), batch.column("turns"))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("path"), pa.array([task] * len(again), pa.int32()), turns], ["conv_id", "path", "task", "turns"])


def _packs(pack_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, stack = _Pack(), []  # the stack: (prefix hash, node) of the path that was written last
        last, turns, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, path, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != last:
                    last, turns = path, _unpressed(raw)
                if pack.size >= pack_tokens or pack.paths >= PACK_PATHS:
                    yield pack.batch(kind)
                    pack, stack = _Pack(), []
                same = 0
                while same < min(len(stack), len(turns)) and stack[same][0] == path[same * KEY : (same + 1) * KEY]:
                    same += 1
                del stack[same:]
                for i in range(same, len(turns)):
                    stack.append((path[i * KEY : (i + 1) * KEY], pack.add(stack[-1][1] if stack else None, *turns[i])))
                pack.leaves.append({"conv_id": conv_id, "path": path, "node": stack[-1][1]["node"]})
                pack.paths += len(path) + 32
        if pack.leaves:
            yield pack.batch(kind)

    return run


def packs(convs: DataFrame, pack_tokens: int = PACK_TOKENS, partitions: int | None = None) -> DataFrame:
    """Packs of the prefix tree: tokens are code points of the formatted text, leaves say which node ends a conversation.

    No conversations give no packs; equal ones are leaves each.  A long
    conversation is held whole by one task.
    """
    kind = convs.schema["conv_id"].dataType.simpleString()
    n = partitions or int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = convs.mapInArrow(_once, f"conv_id {kind}, path binary, task int, turns binary")
    dealt = once.repartitionByRange(n, "path", "task").sortWithinPartitions("path", "task", F.col("turns").isNull())
    return dealt.select("conv_id", "path", "turns").mapInArrow(_packs(pack_tokens), PACK_SCHEMA.format(kind))


def with_positions(packed: DataFrame) -> DataFrame:
    """The packs with a position id for each token."""
    ids = F.flatten(F.transform("nodes", lambda n: F.sequence(n["position"], n["position"] + n["end"] - n["start"] - 1)))
    return packed.withColumn("position_ids", ids)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ancestors"]
    for batch in batches:
        positions = batch.column("position_ids") if "position_ids" in batch.schema.names else [None] * batch.num_rows
        kind = batch.schema.field("leaves").type.value_type.field("conv_id").type
        for tokens, nodes, leaves, at in zip(*(batch.column(i) for i in range(3)), positions, strict=True):
            tokens, nodes, out, known = tokens.values.to_numpy(), nodes.as_py(), [], {}
            at = None if at is None else at.values.to_numpy()
            text_of = lambda a, b: tokens[a:b].astype("<u4").tobytes().decode("utf-32-le")  # noqa: B023, E731
            for leaf in leaves.as_py():
                if leaf["node"] not in known:
                    node = nodes[leaf["node"]]
                    spans = [(x["start"], x["end"]) for x in node["ancestors"]] + [(node["start"], node["end"])]
                    shown = np.concatenate([tokens[a:b] for a, b in spans])
                    if at is not None:  # each token goes where its position id says
                        placed = np.full(len(shown), -1, np.int32)
                        placed[np.concatenate([at[a:b] for a, b in spans])] = shown
                        shown = placed
                    shown = shown.astype("<u4").tobytes().decode("utf-32-le")
                    turns = [(unescape(r), unescape(t)) for r, t in TURN.findall(shown)]
                    chain = [node]
                    while chain[-1]["parent"] >= 0:
                        chain.append(nodes[chain[-1]["parent"]])
                    loss = "".join(unescape(text_of(n["loss_start"], n["loss_end"])) for n in reversed(chain))
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    known = {leaf["node"]: (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown), len(spans) - 1)}
                out.append((leaf["conv_id"], leaf["path"], *known[leaf["node"]]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)


def read_back(packed: DataFrame) -> DataFrame:
    """For each leaf, what its tokens say, in the order of position ids if the packs have them: number and digest of turns, text under the loss mask, size.

    Packs without leaves give no row.
    """
    kind = packed.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    return packed.mapInArrow(_read, f"conv_id {kind}, path binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ancestors long")


def formatted(rows: DataFrame) -> DataFrame:
    """One row per conversation, read back by position ids from the packs that hold it."""
    out = read_back(with_positions(packs(conversations(rows))))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
