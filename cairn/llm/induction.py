"""External induced sorting of suffixes to a bounded depth, with disk-backed priority queues.

A suffix tuple has the bytes around a place of a text: EDGE to the left of it and LENGTH from it on. The order
of the empty suffixes that begin LENGTH bytes after the places is any order. From the order of suffixes that of
those one byte longer is induced, again and again: tuples come out of one queue in order and go, with the
byte before them, into the next, whose order is that byte and then the order of arrival. With every tuple
goes the length of the prefix that it has in common with the one before it: one more than the least such
length between their successors. After LENGTH steps the suffixes at the places are in order, and after j more
those j bytes to the left.

A queue holds a bounded number of bytes in memory. What is over goes to runs on disk, sorted by byte, each a
file of 256 stretches; it is read in blocks. Runs lie in the shared folder of the cluster and go as soon as
they have been read. A shard that fits the bound is sorted by numbers of tuples instead of whole tuples.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.fs as pafs

#: Bytes of repeated strings, and how far left of a place they may begin.
LENGTH, EDGE = 50, 30
TUPLE = np.dtype([("doc", "<i8"), ("part", "<i4"), ("at", "<u4"), ("left", "u1"), ("right", "u1"), ("near", "u1", (EDGE + LENGTH,))])
NONE = (1 << 63) - 1


class Scratch:
    """Files of one task, in a folder of its own below `place`."""

    def __init__(self, place: str) -> None:
        self.place, self.made, self.n, self.bytes = place, False, 0, 0

    def write(self, *arrays: np.ndarray) -> str:
        if not self.made:  # only a shard that doesn't fit memory needs the store
            self.fs, base = pafs.FileSystem.from_uri(self.place)
            self.base = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
            self.fs.create_dir(self.base, recursive=True)
            self.made = True
        self.n += 1
        path = f"{self.base}/{self.n}"
        with self.fs.open_output_stream(path) as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a).view(np.uint8).data)
                self.bytes += a.nbytes
        return path

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.base)
            self.made = False


class ByteQueue:
    """Priority queue of (common prefix, tuple): the smallest byte first, equal bytes as they arrived.

    Once filled it can be read more than once, and is then closed.
    """

    def __init__(self, scratch: Scratch, budget: int, block: int) -> None:
        self.scratch, self.budget, self.block = scratch, budget, block
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.runs: list[tuple[str, np.ndarray, np.dtype]] = []
        self.size = 0

    def push(self, byte: np.ndarray, common: np.ndarray, who: np.ndarray) -> None:
        """Tuples in the order of their bytes, equal ones in their order of arrival."""
        self.held.append((np.searchsorted(byte, np.arange(257)), common, who))
        self.size += common.nbytes + who.nbytes
        if self.size > self.budget:
            self._spill()

    def _spill(self) -> None:
        cuts = np.sum([c for c, _, _ in self.held], axis=0)
        pieces = [(held, slice(int(held[0][b]), int(held[0][b + 1]))) for b in range(256) for held in self.held]
        common, who = (np.concatenate([held[k][own] for held, own in pieces]) for k in (1, 2))
        self.runs.append((self.scratch.write(common, who), cuts, who.dtype))
        self.held, self.size = [], 0

    @property
    def single(self) -> bool:
        return not self.runs and len(self.held) <= 1

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(common, who) in order, a bounded number of tuples at a time."""
        if self.single:
            yield from ((common, who) for _, common, who in self.held if len(who))
            return
        files = [self.scratch.fs.open_input_file(path) for path, _, _ in self.runs]
        try:
            some: list[tuple[np.ndarray, np.ndarray]] = []
            n = 0
            for piece in self._pieces(files):
                some.append(piece)
                n += len(piece[0])
                if n >= self.block:
                    yield np.concatenate([c for c, _ in some]), np.concatenate([w for _, w in some])
                    some, n = [], 0
            if n:
                yield np.concatenate([c for c, _ in some]), np.concatenate([w for _, w in some])
        finally:
            for f in files:
                f.close()

    def _pieces(self, files: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in range(256):
            for f, (_, cuts, kind) in zip(files, self.runs, strict=True):
                for a in range(int(cuts[b]), int(cuts[b + 1]), self.block):
                    e = min(a + self.block, int(cuts[b + 1]))
                    common = np.frombuffer(f.read_at(e - a, a), np.uint8)
                    yield common, np.frombuffer(f.read_at((e - a) * kind.itemsize, int(cuts[256]) + a * kind.itemsize), kind)
            for cuts, common, who in self.held:
                if cuts[b] < cuts[b + 1]:
                    own = slice(int(cuts[b]), int(cuts[b + 1]))
                    yield common[own], who[own]

    def close(self) -> None:
        for path, _, _ in self.runs:
            self.scratch.fs.delete_file(path)
        self.held, self.runs, self.size = [], [], 0


def induce(blocks: Iterable[tuple[np.ndarray, np.ndarray]], byte_of, queue: ByteQueue) -> None:
    """Put tuples that come in order into the queue of the suffixes one byte longer."""
    since, seen = np.zeros(256, np.uint8), np.zeros(256, bool)  # of each byte: least common prefix since the last tuple with it
    for common, who in blocks:
        byte = byte_of(who)
        turn = np.argsort(byte, kind="stable")
        s = byte[turn]
        new = np.zeros(len(s), np.uint8)
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        tail = np.append(head[1:], len(s)) - 1
        for a, b in zip(head.tolist(), tail.tolist(), strict=True):
            if a < b:  # ranges between neighbours of one byte lie end to end
                own = turn[a : b + 1]
                new[a + 1 : b + 1] = np.minimum.reduceat(common[: own[-1] + 1], own[:-1] + 1) + 1
        own = s[head]
        so_far = np.minimum.accumulate(common)
        new[head] = np.where(seen[own], np.minimum(since[own], so_far[turn[head]]) + 1, 0)
        after = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
        since = np.minimum(since, so_far[-1])
        since[own], seen[own] = after[turn[tail] + 1], True
        queue.push(s, new, who[turn])


class _Inside:
    """Tuples in memory: who is a tuple's number, and what is found is kept in a mask of each."""

    def __init__(self, tuples: np.ndarray) -> None:
        self.t = tuples
        self.columns = np.ascontiguousarray(tuples["near"].T)
        self.docs, self.left, self.right = (np.ascontiguousarray(tuples[c]) for c in ("doc", "left", "right"))
        self.mask = np.zeros(len(tuples), np.uint32)

    def byte(self, who: np.ndarray, k: int) -> np.ndarray:
        return self.columns[k][who]

    def doc(self, who: np.ndarray, j: int) -> np.ndarray:
        return np.where((self.left[who] >= j) & (self.right[who] >= LENGTH - j), self.docs[who], NONE)

    def found(self, who: np.ndarray, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        self.mask[who] |= np.uint32(1 << j)
        return iter(())

    def end(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        hit = np.flatnonzero(self.mask)
        yield from _by_part(self.t["part"][hit], self.t["at"][hit], self.mask[hit])


class _Outside:
    """Tuples on disk: who is the tuple itself."""

    def byte(self, who: np.ndarray, k: int) -> np.ndarray:
        return np.ascontiguousarray(who["near"][:, k])

    def doc(self, who: np.ndarray, j: int) -> np.ndarray:
        return np.where((who["left"] >= j) & (who["right"] >= LENGTH - j), who["doc"], NONE)

    def found(self, who: np.ndarray, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield from _by_part(who["part"], who["at"], np.full(len(who), 1 << j, np.uint32))

    def end(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return iter(())


def _by_part(part: np.ndarray, at: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    for p, k in zip(own.tolist(), np.split(order, first[1:]), strict=True):
        yield p, at[k], mask[k]


def _told(queue: ByteQueue, shape: _Inside | _Outside, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Tuples whose string from j bytes left on is that of a smaller document too; equal strings are neighbours with LENGTH bytes in common."""

    def grouped(common: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        head = np.flatnonzero(common < LENGTH)
        if not len(head) or head[0]:
            head = np.append(0, head)  # the first group began in the block before
        doc = shape.doc(who, j)
        return head, doc, np.minimum.reduceat(doc, head)

    over: dict[int, int] = {}  # of groups at an edge of a block, their smallest document
    if not queue.single:
        g = -1
        for common, who in queue.blocks():
            head, _, least = grouped(common, who)
            g += int(common[0] < LENGTH)
            for k in {0, len(head) - 1}:
                over[g + k] = min(over.get(g + k, NONE), int(least[k]))
            g += len(head) - 1
    g = -1
    for common, who in queue.blocks():
        head, doc, least = grouped(common, who)
        g += int(common[0] < LENGTH)
        if over:
            for k in {0, len(head) - 1}:
                least[k] = over[g + k]
        g += len(head) - 1
        if not over and len(head) == len(who):
            continue
        hit = (doc != NONE) & (np.repeat(least, np.diff(np.append(head, len(who)))) < doc)
        if hit.any():
            yield from shape.found(who[hit], j)


def repeats(tuples: Iterable[np.ndarray], place: str, budget: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, at, mask) for arrays of TUPLE: bit j is set if the string j bytes left of `at` also starts in a smaller document.

    place: folder for runs; budget: bytes of tuples that a queue holds.
    """
    scratch = Scratch(place)
    shape: _Inside | _Outside | None
    block = max(1, budget // (2 * TUPLE.itemsize))
    now = ByteQueue(scratch, budget, block)
    try:
        held: list[np.ndarray] = []
        n, shape = 0, None
        for t in tuples:
            held.append(t)
            n += len(t)
            if shape is None and n <= budget // TUPLE.itemsize:
                continue
            shape = _Outside()  # more than fits: all goes to the queue of the empty suffixes
            for x in held:
                for a in range(0, len(x), block):
                    now.push(np.zeros(min(block, len(x) - a), np.uint8), np.zeros(min(block, len(x) - a), np.uint8), x[a : a + block])
            held = []
        if not n:
            return
        if shape is None:
            shape = _Inside(np.concatenate(held))
            now.push(np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32))
        for step in range(LENGTH + EDGE + 1):
            j = step - LENGTH
            if j >= 0:
                yield from _told(now, shape, j)
            if j < EDGE:
                after = ByteQueue(scratch, budget, block)
                induce(now.blocks(), lambda who, k=EDGE + LENGTH - 1 - step: shape.byte(who, k), after)  # noqa: B023
                now.close()
                now = after
        yield from shape.end()
    finally:
        scratch.close()
