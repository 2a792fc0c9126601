"""Partial-order consensus: sequences aligned to a graph of all before them, and the heaviest path through it."""

from __future__ import annotations

import re

import numpy as np

MATCH, MISMATCH, GAP = 2, -3, -2


class Graph:
    """Letters as nodes, in topological order of a DAG between a start (0) and an end (1); edges count how often they were walked."""

    def __init__(self) -> None:
        self.letter: list[int] = [-1, -1]
        self.into: list[dict[int, int]] = [{}, {}]
        self.ring: list[list[int]] = [[0], [1]]  # nodes that stand for each other's place

    def _node(self, letter: int) -> int:
        self.letter.append(letter)
        self.into.append({})
        self.ring.append([len(self.letter) - 1])
        return len(self.letter) - 1

    def order(self) -> list[int]:
        waits = [len(x) for x in self.into]
        out: list[list[int]] = [[] for _ in self.letter]
        for v, before in enumerate(self.into):
            for u in before:
                out[u].append(v)
        todo, done = [v for v, n in enumerate(waits) if not n and v != 1], []
        while todo:
            v = todo.pop()
            done.append(v)
            for x in out[v]:
                waits[x] -= 1
                if not waits[x]:
                    todo.append(x)
        return [v for v in done if v != 1]

    def add(self, seq: str, weight: int) -> None:
        """Align a sequence from end to end and merge it, walked `weight` times."""
        codes = np.frombuffer(seq.encode("utf-32-le"), np.uint32).astype(np.int64)
        before = 0
        for node, place in self._aligned(codes) if len(self.letter) > 2 else [(None, j) for j in range(len(codes))]:
            if place is None:
                continue
            c = int(codes[place])
            if node is None:
                own = self._node(c)
            else:
                own = next((x for x in self.ring[node] if self.letter[x] == c), None)
                if own is None:
                    own = self._node(c)
                    self.ring[own] = self.ring[node]
                    self.ring[node].append(own)
            self.into[own][before] = self.into[own].get(before, 0) + weight
            before = own
        self.into[1][before] = self.into[1].get(before, 0) + weight

    def _aligned(self, codes: np.ndarray) -> list[tuple[int | None, int | None]]:
        """(node, place) pairs from start to end; None for what has no partner."""
        order, size = self.order(), len(codes)
        row = {v: i for i, v in enumerate(order)}
        slope = GAP * np.arange(size + 1)
        score = np.empty((len(order), size + 1), np.int64)
        for i, v in enumerate(order):
            if v == 0:
                score[i] = slope
                continue
            above = [score[row[u]] for u in self.into[v]]
            top = above[0] if len(above) == 1 else np.maximum.reduce(above)
            base = top + GAP
            base[1:] = np.maximum(base[1:], top[:-1] + np.where(codes == self.letter[v], MATCH, MISMATCH))
            score[i] = np.maximum.accumulate(base - slope) + slope
        v = min(self.into[1], key=lambda u: (-score[row[u], size], u))
        j, out = size, []
        while v != 0 or j:
            here = score[row[v], j]
            if v:
                for u in self.into[v]:
                    if j and score[row[u], j - 1] + (MATCH if codes[j - 1] == self.letter[v] else MISMATCH) == here:
                        out.append((v, j - 1))
                        v, j = u, j - 1
                        break
                else:
                    for u in self.into[v]:
                        if score[row[u], j] + GAP == here:
                            out.append((v, None))
                            v = u
                            break
                    else:
                        out.append((None, j - 1))
                        j -= 1
            else:
                out.append((None, j - 1))
                j -= 1
        return out[::-1]

    def heaviest(self) -> str:
        """From the end back along the edge that was walked most; of equals that whose way is heavier, then the least letter."""
        total = [0] * len(self.letter)
        pick: list[int] = [0] * len(self.letter)
        for v in [*self.order(), 1]:
            if v and self.into[v]:
                u = max(self.into[v], key=lambda u: (self.into[v][u], total[u], -self.letter[u], -u))
                pick[v], total[v] = u, total[u] + self.into[v][u]
        out, v = [], pick[1] if self.into[1] else 0
        while v != 0:
            out.append(chr(self.letter[v]))
            v = pick[v]
        return "".join(out[::-1])


def consensus(pieces: list[tuple[str, int]]) -> tuple[str, int]:
    """(the sequence that weighted pieces show, their weight), the first piece being the backbone."""
    total = sum(n for _, n in pieces)
    if len({text for text, _ in pieces}) == 1:
        return pieces[0][0], total
    g = Graph()
    for text, n in pieces:
        g.add(text, n)
    return g.heaviest(), total


def cut_at(hit: dict, bounds: list[int]) -> list[int | None]:
    """Where a read is when its alignment takes each place of a draft (ascending); None beyond the aligned stretch.

    What is inserted right before a bound lies before the cut.
    """
    out: list[int | None] = [None] * len(bounds)
    at = next((x for x, b in enumerate(bounds) if b >= hit["t_start"]), len(bounds))
    i, j = hit["q_start"], hit["t_start"]
    for n, op in ((int(n), op) for n, op in re.findall(r"([0-9]+)([MID])", hit["cigar"])):
        if op != "I":
            while at < len(bounds) and bounds[at] < j + n:
                out[at] = i + (bounds[at] - j if op == "M" else 0)
                at += 1
        i, j = i + n * (op != "D"), j + n * (op != "I")
    if at < len(bounds) and bounds[at] == j:
        out[at] = i
    return out


def windows(draft: str, size: int) -> list[int]:
    """Bounds of stretches of about `size` letters."""
    n = max(1, round(len(draft) / size))
    return [len(draft) * x // n for x in range(n + 1)]
