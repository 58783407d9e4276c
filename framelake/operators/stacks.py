"""What a run of events makes of a stack nobody has seen yet.

Events push a stage, undo the last one, clear all, or rewind to before the first entry of a stage. Whatever stack S a run of events meets, what
is left of S is a beginning of it: its length only shrinks, by undoing, and by rewinds that find their stage in it. A rewind that
cuts S leaves nothing above the cut, so from there on only the later events count. The effect of a run is therefore a small graph. A node is
the start of the run or the moment after a rewind that has cut S. It holds what comes of it if no later rewind cuts S:

* ``pops``, how many entries of S are undone, ``size``, how many entries lie above S at the end, and ``first``, where each of
  their stages occurs first;
* ``waiting``, in the order of time, the first rewind to each stage with the pops up to it and the node to go on from if S holds that
  stage below there. (A later rewind to the same stage finds nothing new in S.)

Effects compose, so segments of a session are summed up alone and combined in any grouping. Entries themselves are never part of
an effect: its size depends on the stages that are rewound to, not on how much is pushed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

#: pops that leave nothing
ALL = 1 << 60
WAYS = 1 << 14


class Node(NamedTuple):
    waiting: list[tuple[str | None, int, int]]
    pops: int
    size: int
    first: dict[str | None, int]


Effect = list[Node]


class Tail:
    """A stack above an unknown one."""

    def __init__(self) -> None:
        self.entries: list[str | None] = []
        self.places: dict[str | None, list[int]] = {}

    def push(self, stage: str | None) -> None:
        self.places.setdefault(stage, []).append(len(self.entries))
        self.entries.append(stage)

    def cut(self, size: int) -> None:
        while len(self.entries) > size:
            self.places[self.entries.pop()].pop()

    def find(self, stage: str | None) -> int | None:
        places = self.places.get(stage)
        return places[0] if places else None

    def first(self) -> dict[str | None, int]:
        return {s: p[0] for s, p in self.places.items() if p}


def _node(events: list[tuple[str, str | None]], start: int) -> Node:
    tail, pops, waiting, asked = Tail(), 0, [], set()
    for i in range(start, len(events)):
        action, stage = events[i]
        if action in ("apply", "adopt"):
            tail.push(stage)
        elif action == "undo":
            if tail.entries:
                tail.cut(len(tail.entries) - 1)
            else:
                pops = min(ALL, pops + 1)
        elif action == "clear":
            tail, pops = Tail(), ALL
        elif action == "rewind":
            if stage not in asked and pops < ALL:
                asked.add(stage)
                waiting.append((stage, i + 1, pops))
            found = tail.find(stage)
            if found is not None:
                tail.cut(found)
    return Node(waiting, pops, len(tail.entries), tail.first())


def _numbered(start, node_of) -> Effect:
    """Nodes that can be reached, numbered from 0; ``node_of`` gives a node whose waiting rewinds name others by any key.

    A stage that has been found in S once is above the cut from then on, so ways that find it again are left out. Where there are more ways
    than ``WAYS`` they stay in, which makes an effect larger, not different.
    """
    made = {start: node_of(start)}
    taken: dict = {start: set()}
    todo = [(start, frozenset())]
    seen = set(todo)
    while todo:
        key, gone = todo.pop()
        few = len(seen) < WAYS
        for stage, child, _ in made[key].waiting:
            if few and stage in gone:
                continue
            taken[key].add(stage)
            if child not in made:
                made[child], taken[child] = node_of(child), set()
            way = (child, gone | {stage} if few else frozenset())
            if way not in seen:
                seen.add(way)
                todo.append(way)
    numbers = {key: k for k, key in enumerate(made)}
    return [Node([(s, numbers[c], p) for s, c, p in n.waiting if s in taken[key]], n.pops, n.size, n.first) for key, n in made.items()]


def effect(events: Iterable[tuple[str, str | None]]) -> Effect:
    events = list(events)
    return _numbered(0, lambda start: _node(events, start))


def then(before: Effect, after: Effect) -> Effect:
    """``after`` on what ``before`` leaves."""
    def node_of(key: tuple[str, int]) -> Node:
        of, number = key
        if of == "after":  # S was cut during ``after``: nothing of ``before`` is left above it
            n = after[number]
            return Node([(s, ("after", c), p) for s, c, p in n.waiting], n.pops, n.size, n.first)
        n = before[number]
        waiting = [(s, ("before", c), p) for s, c, p in n.waiting]
        asked = {s for s, _, _ in waiting}
        pops, size, first, at = n.pops, n.size, n.first, 0
        while at is not None:
            now, at = after[at], None
            for stage, child, popped in now.waiting:
                left, deeper = max(0, size - popped), min(ALL, pops + max(0, popped - size))
                if stage not in asked and deeper < ALL:
                    asked.add(stage)
                    waiting.append((stage, ("after", child), deeper))
                if first.get(stage, left) < left:  # it cuts what ``before`` has pushed
                    size, pops, at = first[stage], deeper, child
                    first = {s: i for s, i in first.items() if i < size}
                    break
        left = max(0, size - now.pops)
        kept = {s: i for s, i in first.items() if i < left}
        return Node(waiting, min(ALL, pops + max(0, now.pops - size)), left + now.size, {s: left + i for s, i in now.first.items()} | kept)

    return _numbered(("before", 0), node_of)


def land(found: Effect, height: int, first: dict[str | None, int]) -> tuple[int, int, dict[str | None, int]]:
    """On a stack of ``height`` entries: how many of them stay, the height afterwards, and where each stage now occurs first."""
    node, left = found[0], height
    while True:
        hit = next(((s, c) for s, c, popped in node.waiting if first.get(s, left) < left - popped), None)
        if hit is None:
            break
        left, node = first[hit[0]], found[hit[1]]
    kept = max(0, left - node.pops)
    return kept, kept + node.size, {s: kept + i for s, i in node.first.items()} | {s: i for s, i in first.items() if i < kept}


def packed(found: Effect) -> bytes:
    return json.dumps([[n.waiting, n.pops, n.size, list(n.first.items())] for n in found]).encode()


def read(held: bytes) -> Effect:
    return [Node([tuple(w) for w in waiting], pops, size, {s: i for s, i in first}) for waiting, pops, size, first in json.loads(held)]


def compose(first: bytes, second: bytes) -> bytes:
    return packed(then(read(first), read(second)))
