"""Repair of conversation structure: the cheapest edits that leave turns of user and assistant, found by A* on the edit lattice.

A node of the lattice is (rows taken, what came last); edits keep, rerole,
delete or insert a row.  The heuristic is the suffix sum of what no path avoids:
deletions of blank and duplicate rows, and the charge of a truncated row, whether
it stays or goes.  The queue is keyed (cost plus heuristic, audit), so that of
equally cheap edits the least audit is found first.  Paths to one node of equal
cost are never prefixes of each other, as an insertion costs more than none: so
the least audit of a node is part of the least audit of all.

Rows are dealt by ranges of (conversation, turn), so that a conversation may
span many tasks.  One that lies within a task and a block is repaired there.  Of
any other, each block of bounded rows gives its cheapest cost from each entry to
each exit state (`block_costs`); a fold over these few numbers picks the states
between blocks, and the blocks are repaired each for itself.  Rows that earlier
blocks show are found by digests.  A SHA-256 is sequential by definition: the
repaired bytes of a conversation pass through one task, as a stream.

Null conversation ids are one conversation, null turns come first, null roles and
texts are as the caller makes them (the query: one space).  Rows of equal turn go
by role and then text; repeated rows are duplicates.  A conversation without rows
that stand there has zeros.  An empty table gives no rows; a long text is held
whole, in a block of its own; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a block: rows and characters; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_CHARS = 1_024, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: States by what came last: nothing, a system turn, a user's, an assistant's; where a letter leads, and where edits may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The letter that may follow a state, other than a system turn.
DUE = ("u", "u", "a", "u")
FINAL = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Row = tuple  # (turn, role, text)


def faults(rows: list[Row], seen: set | None = None, earlier: set | None = None) -> list[str]:
    """The first fault of each row, or ''; `earlier` holds digests of other blocks' rows."""
    out, seen = [], set() if seen is None else seen
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        if not said:
            out.append("blank")
        elif (role, text) in seen or earlier and digest(role, text) in earlier:
            out.append("duplicate")
        else:
            out.append("" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def search(initials: list[str], found: list[str], entry: int, stop: Callable[[dict], bool], exits: tuple[int, ...] = (), trailing: bool = False) -> dict[int, tuple[int, str]]:
    """Exit state to (cost, audit), for those in `exits` that are reached before `stop` says so.

    With `trailing`, insertions behind the last row belong to the path.
    """
    n = len(initials)
    must = [f in ("blank", "duplicate") for f in found]
    charge = [TRUNCATED if f == "truncated" else 0 for f in found]
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if must[i] else charge[i])
    queue: list[tuple[int, str, int, int, bool]] = [(ahead[0], "", 0, entry, False)]
    done, out = set(), {}
    while queue:
        f, audit, i, state, inserted = heapq.heappop(queue)
        if (i, state, inserted) in done:
            continue
        done.add((i, state, inserted))
        cost = f - ahead[i]
        if i == n and state in exits and state not in out and (trailing or not inserted):
            out[state] = (cost, audit)
            if stop(out):
                break
        due = DUE[state]
        if i < n or trailing:
            heapq.heappush(queue, (f + INSERT, audit + "I", i, NEXT[due][state], True))
        if i == n:
            continue
        rest = ahead[i + 1]
        heapq.heappush(queue, (cost + DELETE + rest, audit + "D", i + 1, state, False))
        if not must[i]:
            heapq.heappush(queue, (cost + REROLE + charge[i] + rest, audit + "R", i + 1, NEXT[due][state], False))
            to = NEXT.get(initials[i], {}).get(state)
            if to is not None:
                heapq.heappush(queue, (cost + KEEP + charge[i] + rest, audit + "K", i + 1, to, False))
    return out


def cheapest(initials: list[str], found: list[str]) -> tuple[int, str]:
    """(cost, least audit) of a whole conversation."""
    return min(search(initials, found, START, lambda out: True, FINAL, trailing=True).values())


def applied(rows: list[Row], audit: str, entry: int = START) -> list[str]:
    """The repaired rows as role:text; what a row becomes follows from the state."""
    out, state, i = [], entry, 0
    for op in audit:
        if op != "I":
            _, role, text = rows[i]
            i += 1
            if op == "D":
                continue
        letter = DUE[state] if op in "RI" else role[:1]
        out.append(f"{role if op == 'K' else ROLE[letter]}:{'' if op == 'I' else text}")
        state = NEXT[letter][state]
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _turns(rows: list[Row]) -> list[int]:
    """Distinct turns, ascending; rows are sorted by turn."""
    return list(dict.fromkeys(t for t, _, _ in rows if t is not None))


def whole(rows: list[Row]) -> tuple:
    """RESULT of the rows of one conversation."""
    found, initials, turns = faults(rows), [r[1][:1] for r in rows], _turns(rows)
    cost, audit = cheapest(initials, found)
    text = "\n".join(applied(rows, audit))
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    return gaps, *(found.count(f) for f in FAULTS), _illegal(initials), cost, audit, hashlib.sha256(text.encode()).hexdigest()


_BLOCK = "struct<turns:array<long>,roles:array<string>,texts:array<string>,firsts:array<binary>>"


def _cut(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (conv_id, turn, role, text, times), sorted, to results of conversations that one block holds, and to blocks of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), None
        current: list[Row] = []
        key, state = None, {"any": False, "first": True, "seq": 0, "chars": 0}
        out: list[tuple] = []

        def block() -> tuple:
            seen, firsts = set(), []
            for _, role, text in current:
                if (role, text) not in seen and text.strip(SPACE):
                    firsts.append(digest(role, text))
                seen.add((role, text))
            turns, roles, texts = (list(x) for x in zip(*current, strict=True)) if current else ([], [], [])
            return key, part, state["seq"], None, {"turns": turns, "roles": roles, "texts": texts, "firsts": firsts}

        def close(last: bool) -> None:
            """The conversation ends here: the first and the last of a task may go on in another one."""
            if state["first"] or last or state["seq"]:
                out.append(block())
            else:
                out.append((key, part, 0, dict(zip(_NAMES, whole(current), strict=True)), None))
            current.clear()
            state.update(first=False, seq=0, chars=0)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("seq", pa.int32()), ("done", _DONE_TYPE), ("block", _BLOCK_TYPE)])
            for conv, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state["any"] or conv != key:
                    if state["any"]:
                        close(False)
                    key, state["any"] = conv, True
                for _ in range(times):
                    if current and (len(current) >= BLOCK_ROWS or state["chars"] + len(text) > BLOCK_CHARS):
                        out.append(block())
                        current.clear()
                        state.update(seq=state["seq"] + 1, chars=0)
                    current.append((turn, role, text))
                    state["chars"] += len(text)
            if len(out) >= 256:
                yield flush()
        if state["any"]:
            close(True)
            yield flush()

    return run


_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_DONE_TYPE = pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in RESULT.split(", ")])
_BLOCK_TYPE = pa.struct([("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("firsts", pa.list_(pa.binary()))])


def block_costs(initials: list[str], found: list[str]) -> tuple[list[int | None], list[int]]:
    """Cheapest cost from each entry to each exit (16 numbers, null where there is no way), and the place of each exit's audit among those of its entry."""
    costs: list[int | None] = []
    places: list[int] = []
    for entry in range(4):
        got = search(initials, found, entry, lambda out: len(out) == 4, (0, 1, 2, 3))
        order = sorted(got, key=lambda q: got[q][1])
        costs += [got[q][0] if q in got else None for q in range(4)]
        places += [order.index(q) if q in got else -1 for q in range(4)]
    return costs, places


def _rows(block: dict) -> list[Row]:
    return list(zip(block["turns"], block["roles"], block["texts"], strict=True))


_SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, turns long, low long, high long, costs array<long>, places array<int>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, part, seq, block, earlier) to numbers of fixed size."""
    for batch in batches:
        out = []
        for block, earlier in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            rows = _rows(block)
            found, initials, turns = faults(rows, earlier=set(earlier or ())), [r[1][:1] for r in rows], _turns(rows)
            ends = (initials[0], initials[-1]) if rows else (None, None)
            out.append((len(rows), *(found.count(f) for f in FAULTS), _illegal(initials), *ends, len(turns), *((turns[0], turns[-1]) if turns else (None, None)), *block_costs(initials, found)))
        types = [pa.string() if t == "string" else pa.list_(pa.int64()) if t == "array<long>" else pa.list_(pa.int32()) if t == "array<int>" else pa.int64() for t in (x.split()[1] for x in _SUMMARY.split(", "))]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *cols], ["conv_id", "part", "seq", *(x.split()[0] for x in _SUMMARY.split(", "))])


_PATH = "entry int, exit int, is_last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chosen(part: pa.Table) -> pa.Table:
    """The states between the blocks of one conversation, from numbers of each block, and the conversation's sums with its last block."""
    part = part.sort_by([("part", "ascending"), ("seq", "ascending")])
    rows = part.to_pylist()
    best: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost, place of its audit
    came: list[dict[int, int]] = []
    for r in rows:
        if not r["n"]:
            came.append({q: q for q in best})
            continue
        new: dict[int, tuple[int, tuple[int, int]]] = {}
        back: dict[int, int] = {}
        for entry, (cost, place) in best.items():
            for q in range(4):
                step = r["costs"][4 * entry + q]
                # audits of different entries differ before their ends, so that the entry's place decides
                if step is not None and (q not in new or (cost + step, (place, r["places"][4 * entry + q])) < new[q]):
                    new[q], back[q] = (cost + step, (place, r["places"][4 * entry + q])), entry
        order = sorted(new, key=lambda q: new[q][1])
        best = {q: (new[q][0], order.index(q)) for q in new}
        came.append(back)
    # what is inserted behind the last row: an assistant's turn, or both
    more = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
    state = min(best, key=lambda q: (best[q][0] + more[q], best[q][1]))
    cost = best[state][0] + more[state]
    path = []
    for back in reversed(came):
        path.append((back[state], state))
        state = back[state]
    path.reverse()
    full, turned = [r for r in rows if r["n"]], [r for r in rows if r["turns"]]
    illegal = sum(r["illegal"] for r in rows) + sum(_illegal([a["tail"], b["head"]]) for a, b in zip(full, full[1:], strict=False))
    distinct = sum(r["turns"] for r in turned) - sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:], strict=False))
    gaps = turned[-1]["high"] - turned[0]["low"] + 1 - distinct if turned else 0
    sums = (gaps, *(sum(r[f] for r in rows) for f in FAULTS), illegal, cost)
    n = len(rows)
    cols = [pa.array([p[0] for p in path], pa.int32()), pa.array([p[1] for p in path], pa.int32()), pa.array([i == n - 1 for i in range(n)])]
    cols += [pa.array([None] * (n - 1) + [x], pa.int64()) for x in sums]
    return pa.Table.from_arrays([*(part.column(c) for c in ("conv_id", "part", "seq")), *cols], names=["conv_id", "part", "seq", *(x.split()[0] for x in _PATH.split(", "))])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv_id, part, seq, block, earlier, entry, exit, is_last) to their audits and repaired bytes."""
    for batch in batches:
        audits, texts, counts = [], [], []
        for block, earlier, entry, end, last in zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True):
            rows = _rows(block)
            found = faults(rows, earlier=set(earlier or ()))
            audit = search([r[1][:1] for r in rows], found, entry, lambda out, end=end: end in out, (end,))[end][1] if rows else ""
            audit += {SYSTEM: "II", USER: "I"}.get(end, "") if last else ""
            out = applied(rows, audit, entry)
            audits.append(audit)
            texts.append("\n".join(out).encode())
            counts.append(len(out))
        cols = [pa.array(audits), pa.array(texts, pa.binary()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *cols], ["conv_id", "part", "seq", "audit", "text", "rows"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, audit, text, rows), in order, to (conv_id, audit, repaired_sha256): a stream that holds a hash and the audit's parts."""
    key, begun, audits, sha, some = None, False, [], hashlib.sha256(), False
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        done = []
        for conv, audit, text, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if begun and conv != key:
                done.append((key, "".join(audits), sha.hexdigest()))
                audits, sha, some = [], hashlib.sha256(), False
            key, begun = conv, True
            audits.append(audit)
            if rows:
                sha.update(b"\n" if some else b"")
                sha.update(text)
                some = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.string(), pa.string()), strict=True)], ["conv_id", "audit", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array(["".join(audits)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])


def repairs(rows: DataFrame, scratch, times: Column | None = None) -> DataFrame:
    """conv_id and RESULT for each conversation of rows (conv_id, turn, role, text).

    `times` says how often a row stands there (0: it doesn't, but its
    conversation is reported).  `scratch` (lineage.Scratch) holds blocks and
    their summaries.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), (F.lit(1) if times is None else times).cast("int").alias("times"))
    heads = [F.substring(c, 1, 64) for c in ("role", "text")]  # ranges are sampled on the driver, without whole texts
    dealt = r.repartitionByRange("conv_id", "turn", *heads).sortWithinPartitions("conv_id", "turn", "role", "text")
    done = f"struct<{', '.join(x.replace(' ', ':') for x in RESULT.split(', '))}>"
    blocks = scratch.cut(dealt.mapInArrow(_cut(kind), f"conv_id {kind}, part int, seq int, done {done}, block {_BLOCK}"), "blocks")
    open_ = blocks.where(F.col("block").isNotNull()).select("conv_id", "part", "seq", "block")

    at = F.struct("part", "seq")
    from pyspark.sql import Window

    shown = open_.select("conv_id", "part", "seq", F.explode("block.firsts").alias("digest"))
    again = shown.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(at))).where("r > 1")
    earlier = again.groupBy("conv_id", "part", "seq").agg(F.collect_set("digest").alias("earlier"))  # at most a block's rows
    earlier = earlier.select(F.col("conv_id").alias("e_conv"), F.col("part").alias("e_part"), F.col("seq").alias("e_seq"), "earlier")
    same = (F.col("part") == F.col("e_part")) & (F.col("seq") == F.col("e_seq")) & F.col("conv_id").eqNullSafe(F.col("e_conv"))
    known = open_.join(earlier, same, "left").select("conv_id", "part", "seq", "block", "earlier")

    summaries = known.mapInArrow(_summaries, f"conv_id {kind}, part int, seq int, {_SUMMARY}")
    paths = scratch.cut(summaries.groupBy("conv_id").applyInArrow(_chosen, f"conv_id {kind}, part int, seq int, {_PATH}"), "paths")
    chosen = paths.select(F.col("conv_id").alias("p_conv"), F.col("part").alias("p_part"), F.col("seq").alias("p_seq"), "entry", "exit", "is_last")
    same = (F.col("part") == F.col("p_part")) & (F.col("seq") == F.col("p_seq")) & F.col("conv_id").eqNullSafe(F.col("p_conv"))
    pieces = known.join(chosen, same).select("conv_id", "part", "seq", "block", "earlier", "entry", "exit", "is_last").mapInArrow(_repaired, f"conv_id {kind}, part int, seq int, audit string, text binary, rows long")
    streamed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "audit", "text", "rows").mapInArrow(_hashed, f"conv_id {kind}, audit string, repaired_sha256 string")
    sums = paths.where("is_last").select(F.col("conv_id").alias("p_conv"), *_NAMES[:6])
    spanning = streamed.join(sums, F.col("conv_id").eqNullSafe(F.col("p_conv"))).select("conv_id", *_NAMES)
    return blocks.where(F.col("done").isNotNull()).select("conv_id", "done.*").unionByName(spanning)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with planted faults, and how often each stands there: by crc32 of `conv_id:turn` modulo 20, nulls as one space.

    0 drops a row, 1 empties its text, 2 removes its marks of an end, 3 repeats
    it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), kind.alias("kind"))
    return out, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
