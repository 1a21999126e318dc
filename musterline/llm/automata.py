"""Acyclic count transducers: word sequences with counts, as minimal deterministic automata.

A transducer reads a sequence label by label and adds up what its arcs and the last state give:
the count of the sequence. It is built from sorted sequences one at a time: what a new sequence
does not share with the one before it is finished, so its states are frozen from the end: each
passes what all its ways out have in common to the arc that leads to it, and is replaced by the
equal state that was frozen earlier, if there is one. Only the path of the current sequence is open.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np

Item = tuple[tuple[str, ...], int]


class Transducer:
    """States are numbered; state s gives final[s] (None: it ends nothing) and has the arcs arcs[s]: (label, state, count), by label."""

    def __init__(self, arcs: list[tuple], final: list[int | None], start: int):
        self.arcs, self.final, self.start = arcs, final, start

    @classmethod
    def build(cls, items: Iterable[Item]) -> Transducer:
        """From distinct sequences in order."""
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []
        final: list[int | None] = []

        def freeze(state: list) -> tuple[int, int]:
            """The number of the frozen state, and the count that belongs to the arc leading to it."""
            end, out = state
            least = min([x[2] for x in out] + ([end] if end is not None else []), default=0)
            key = (None if end is None else end - least, tuple((a, b, c - least) for a, b, c in out))
            at = register.get(key)
            if at is None:
                at = register[key] = len(arcs)
                final.append(key[0])
                arcs.append(key[1])
            return at, least

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                at, least = freeze(path.pop())
                path[-1][1].append((before[len(path) - 1], at, least))

        path: list[list] = [[None, []]]
        before: tuple[str, ...] = ()
        for labels, count in items:
            shared = 0
            for x, y in zip(before, labels):
                if x != y:
                    break
                shared += 1
            close(shared)
            path.extend([None, []] for _ in range(len(labels) - shared))
            path[-1][0] = count
            before = labels
        close(0)
        final.append(path[0][0])  # the start has no arc to it that could take a count
        arcs.append(tuple(path[0][1]))
        return cls(arcs, final, len(arcs) - 1)

    def items(self) -> Iterator[Item]:
        """All sequences in order."""
        stack = [(self.start, (), 0)]
        while stack:
            at, labels, total = stack.pop()
            if self.final[at] is not None:
                yield labels, total + self.final[at]
            for label, to, count in reversed(self.arcs[at]):
                stack.append((to, (*labels, label), total + count))

    def compose(self, asked: Transducer) -> Iterator[Item]:
        """The sequences of `asked` that this transducer counts, in order: both are walked at once along common labels."""
        stack = [(self.start, asked.start, (), 0)]
        while stack:
            at, other, labels, total = stack.pop()
            if self.final[at] is not None and asked.final[other] is not None:
                yield labels, total + self.final[at]
            mine = {label: (to, count) for label, to, count in self.arcs[at]} if asked.arcs[other] else {}
            for label, to, _ in reversed(asked.arcs[other]):
                if label in mine:
                    stack.append((mine[label][0], to, (*labels, label), total + mine[label][1]))

    def pack(self) -> tuple[list[str], bytes]:
        """Labels, and one row of longs for each state and arc: what `unpack` takes."""
        labels = sorted({x[0] for out in self.arcs for x in out})
        place = {x: i for i, x in enumerate(labels)}
        rows = [(self.start, len(self.arcs), 0)]
        for end, out in zip(self.final, self.arcs):
            rows.append((-1 if end is None else end, len(out), 0))
            rows.extend((place[a], b, c) for a, b, c in out)
        return labels, np.array(rows, np.int64).tobytes()

    @classmethod
    def unpack(cls, labels: list[str], packed: bytes) -> Transducer:
        rows = np.frombuffer(packed, np.int64).reshape(-1, 3).tolist()
        start, states, _ = rows[0]
        arcs, final, k = [], [], 1
        for _ in range(states):
            end, n, _ = rows[k]
            final.append(None if end < 0 else end)
            arcs.append(tuple((labels[a], b, c) for a, b, c in rows[k + 1 : k + 1 + n]))
            k += n + 1
        return cls(arcs, final, start)


def union(parts: Iterable[Transducer], least: int = 0) -> Transducer:
    """Counts of equal sequences added up, without those whose sum is below `least`."""
    merged = heapq.merge(*(x.items() for x in parts))
    summed = ((labels, sum(c for _, c in same)) for labels, same in groupby(merged, key=lambda x: x[0]))
    return Transducer.build(x for x in summed if x[1] >= least)
