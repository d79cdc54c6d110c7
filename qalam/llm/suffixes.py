"""Suffix sorting by induction, in batches, with disk-backed queues.

Suffixes that start with one symbol leave its queue in batches; a batch
induces, in order, the suffixes one position to the left, which enter the
queues of their own first symbols. So each step is a few array operations,
and what waits in the queues goes to a scratch file beyond a memory budget.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that the queues of one sort hold in memory before they go to a scratch file.
QUEUE_BYTES = 64 << 20


class Queues:
    """First-in first-out queues of positions by symbol; the oldest part may lie in a scratch file."""

    def __init__(self, symbols: int, budget: int = QUEUE_BYTES):
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.stored: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.held, self.budget, self.file = 0, budget, None

    def push(self, positions: np.ndarray, symbols: np.ndarray) -> None:
        """Append positions, each to its symbol's queue, in the order given."""
        if not len(positions):
            return
        by = np.argsort(symbols, kind="stable")
        positions, symbols = positions[by], symbols[by]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for part, s in zip(np.split(positions, cuts), symbols[np.concatenate([[0], cuts])].tolist()):
            self.waiting[s].append(part)
        self.held += positions.nbytes
        if self.held > self.budget:
            self._store()

    def _store(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for s, parts in enumerate(self.waiting):
            for part in parts:
                at = self.file.seek(0, 2)
                part.tofile(self.file)
                self.stored[s].append((at, len(part)))
            self.waiting[s] = []
        self.held = 0

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """Empty a queue, oldest first; more may be pushed to other queues meanwhile."""
        for at, n in self.stored[symbol]:
            self.file.seek(at)
            yield np.fromfile(self.file, np.int32, n)
        parts, self.waiting[symbol], self.stored[symbol] = self.waiting[symbol], [], []
        if parts:
            whole = np.concatenate(parts)
            self.held -= whole.nbytes
            yield whole

    def close(self) -> None:
        if self.file:
            self.file.close()


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(t)
    small = np.ones(n, bool)
    change = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    small[:-1] = (t[:-1] < t[1:])[np.minimum(change, n - 2)]
    return small


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int, budget: int) -> np.ndarray:
    """The order of all suffixes from that of the seeds (the leftmost small ones), given by ascending first symbol."""
    edges = np.searchsorted(t[seeds], np.arange(symbols + 1))
    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def induced(batch: np.ndarray, want_small: bool) -> tuple[np.ndarray, np.ndarray]:
        left = batch[batch > 0] - 1
        left = left[small[left] == want_small]
        return left, t[left]

    def bucket(queues: Queues, c: int, out: list[np.ndarray], want_small: bool) -> None:
        todo = list(queues.take(c))
        while todo:  # a run of one symbol induces into its own bucket
            batch = todo.pop(0)
            out.append(batch)
            left, first = induced(batch, want_small)
            own = first == c
            if own.any():
                todo.append(left[own])
            queues.push(left[~own], first[~own])

    queues = Queues(symbols, budget)
    for c in range(symbols):
        bucket(queues, c, large[c], False)
        queues.push(*induced(seeds[edges[c]:edges[c + 1]], False))
    queues.close()
    queues, out = Queues(symbols, budget), []
    for c in reversed(range(symbols)):
        least: list[np.ndarray] = [seeds[:1]] if c == 0 else []  # the end mark, which nothing induces
        bucket(queues, c, least, True)
        down = np.concatenate(large[c])[::-1] if large[c] else seeds[:0]
        queues.push(*induced(down, True))
        out += [*least, down]
    queues.close()
    return np.concatenate(out)[::-1]


def _named(t: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the substrings [at, ends] that stand in order: equal ones share a name."""
    size = ends - at
    new = np.ones(len(at), bool)
    new[1:] = size[1:] != size[:-1]
    live, j = np.flatnonzero(~new), 0
    while len(live):
        differ = t[at[live] + j] != t[at[live - 1] + j]
        new[live[differ]] = True
        j += 1
        live = live[~differ & (size[live] >= j)]
    return np.cumsum(new) - 1


def suffix_order(t: np.ndarray, symbols: int, depth: int, budget: int = QUEUE_BYTES) -> np.ndarray:
    """Start positions by the first ``depth`` symbols (at least) of their suffixes.

    ``t`` holds 0..symbols-1 (16-bit: such keys sort by radix) and ends with its only 0; it has fewer than 2^31 symbols. The leftmost small
    suffixes are seeds: a first induction sorts the substrings between them,
    their names make a shorter string whose suffixes are ranked by doubling
    -- as each name spans two symbols or more, ``depth`` symbols take a few
    rounds, where full recursion would go on -- and a second induction gives
    the order of all suffixes.
    """
    if len(t) < 2:
        return np.arange(len(t))
    small = _types(t)
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    mark = np.zeros(len(t), bool)
    mark[seeds] = True
    order = _induce(t, small, seeds[::-1][np.argsort(t[seeds[::-1]], kind="stable")], symbols, budget)
    order = order[mark[order]]
    nxt = np.append(seeds[1:], len(t) - 1)
    number = np.cumsum(mark, dtype=np.int32) - 1
    place = number[order]
    rank = np.empty(len(seeds), np.int64)
    rank[place] = _named(t, order, nxt[place])
    step = 1
    while 2 * step <= 2 * depth and rank.max() + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-step or None] = rank[step:] + 1 if step < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]
        step *= 2
    return _induce(t, small, seeds[np.argsort(rank, kind="stable")], symbols, budget)


def repeated(pieces: list[bytes], width: int, budget: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal ``width``-byte strings: (group, piece, offset) of every member of a group of two or more."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    # bytes become 2.., 1 ends a piece, 0 ends the text
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    t = np.zeros(len(data) + 1, np.uint16)
    t[:-1] = data
    t[:-1] += 2
    t[ends] = 1
    of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    fits = np.append(ends[of] - np.arange(len(data)) >= width, False)
    order = suffix_order(t, 258, width, budget)
    order = order[fits[order]]
    piece = of[order]
    same = np.zeros(len(order), bool)
    live, j = np.arange(1, len(order)), 0
    # neighbours' common prefixes as far as the width, eight bytes a step
    eight = np.ndarray(max(0, len(data) - 7), np.uint64, data.tobytes(), strides=(1,))
    while len(live) and j < width:
        at = min(j, width - 8) if width >= 8 else j
        text = eight if width >= 8 else t
        live = live[text[order[live] + at] == text[order[live - 1] + at]]
        j = at + 8 if width >= 8 else j + 1
    same[live] = True
    group = np.cumsum(~same)
    many = same.copy()
    many[:-1] |= same[1:]
    return group[many], piece[many], (order - (ends[piece] - sizes[piece]))[many]
