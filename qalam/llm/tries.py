"""Compressed radix tries over whole byte strings, and ranges of texts by adaptive prefixes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A range holds about the 256th part of the texts' bytes, between these bounds; there are at most so many ranges.
SHARE, LEAST_BYTES, MOST_BYTES, MOST_RANGES = 256, 1 << 20, 16 << 20, 65_536
#: A text counts this many bytes more, for its row.
ROW_BYTES = 64


class Node:
    """``text[start:end]`` labels the edge to the node; ``rows`` is what its text carries if one ends here."""
    __slots__ = ("text", "start", "end", "children", "rows")

    def __init__(self, text: bytes, start: int, end: int):
        self.text, self.start, self.end, self.children, self.rows = text, start, end, {}, None


def shared(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common prefix of ``a[i:]`` and ``b[j:]``, by slices of doubling length."""
    most = min(len(a) - i, len(b) - j)
    at, step = 0, 16
    while at < most:
        step = min(step, most - at)
        if a[i + at:i + at + step] == b[j + at:j + at + step]:
            at, step = at + step, step * 2
        elif step == 1:
            break
        else:
            step = (step + 1) // 2
    return at


class Trie:
    """A trie whose edges are slices of the texts inserted, so each distinct text is held once."""

    def __init__(self):
        self.root = Node(b"", 0, 0)

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text, at, len(text))
                return child
            size = child.end - child.start
            if not text.startswith(child.text[child.start:child.end], at):
                size = min(size, shared(text, at, child.text, child.start))
                upper = node.children[text[at]] = Node(child.text, child.start, child.start + size)
                child.start += size
                upper.children[child.text[child.start]] = child
                child = upper
            node, at = child, at + size
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """Every (text, node) that carries rows, in byte order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.rows is not None:
                yield node.text[:node.end], node
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]


@dataclass
class Ranges:
    """Texts from ``starts[i]`` up to the next start are range i; a range may be dealt to several ``salts``."""
    starts: list[bytes]
    salts: list[int]

    def __post_init__(self):
        self.first = [0]
        for n in self.salts:
            self.first.append(self.first[-1] + n)

    def of(self, text: bytes) -> int:
        return bisect_right(self.starts, text) - 1


def _common(a: bytes, b: bytes) -> bytes:
    return a[:shared(a, 0, b, 0)]


def _weigh(batches: Iterator[pa.RecordBatch], nodes: list[bytes], look: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the texts below each node by their next two bytes, and what those texts have in common.

    Texts with equal hashes weigh once for each block of a task, as equal
    texts are folded there before they are dealt out.
    """
    found: dict[tuple[int, bytes], list] = {}
    seen: set[int] = set()
    for batch in batches:
        for head, size, h in zip(*(batch.column(c).to_pylist() for c in ("_head", "_size", "_hash"))):
            n = bisect_right(nodes, head) - 1
            if n < 0 or not head.startswith(nodes[n]) or h in seen:
                continue
            seen.add(h)
            at = len(nodes[n])
            got = found.setdefault((n, head[at:at + 2]), [0, head[at:at + look]])
            got[0] += size
            if not head.startswith(got[1], at):
                got[1] = _common(got[1], head[at:at + look])
        if len(seen) > 200_000:
            seen.clear()
    yield pa.RecordBatch.from_pydict({
        "node": pa.array([n for n, _ in found], pa.int32()), "next": pa.array([k for _, k in found], pa.binary()),
        "bytes": pa.array([v[0] for v in found.values()], pa.int64()),
        "common": pa.array([v[1] for v in found.values()], pa.binary())})


def prefix_ranges(docs: DataFrame, text: Column, share: int = SHARE, least: int = LEAST_BYTES,
                  most: int = MOST_BYTES) -> Ranges:
    """Ranges of about equal bytes, cut by the shortest prefixes that do it.

    Level by level: the texts below every prefix that is still too heavy are
    weighed by their next two bytes; light neighbours share a range, heavy
    ones go on behind what their texts have in common. All rows are weighed;
    the driver holds the children of heavy prefixes only, at most
    ``MOST_RANGES`` of which are heavy. A range that is one text alone cannot
    be cut: it gets as many salts as its bytes need. Ranges steer where work
    is done, never what comes out.
    """
    nodes, look, target = [b""], 64, None
    cuts: dict[bytes, int] = {b"": 1}
    while nodes:
        width = max(map(len, nodes)) + look
        heads = docs.select(F.substring(text, 1, width).cast("binary").alias("_head"),
                            (F.octet_length(text) + ROW_BYTES).cast("long").alias("_size"), F.xxhash64(text).alias("_hash"))
        rows = heads.mapInArrow(lambda batches: _weigh(batches, nodes, look),
                                "node int, next binary, bytes long, common binary").groupBy("node", "next").agg(
            F.sum("bytes").alias("bytes"), F.min("common").alias("low"), F.max("common").alias("high")).collect()
        if target is None:
            total = sum(r.bytes for r in rows)
            target = max(least, min(most, total // share), total // MOST_RANGES)
        heavy, filled, before = [], 0, None
        for r in sorted(rows, key=lambda r: (r.node, bytes(r.next))):
            prefix, key = nodes[r.node], bytes(r.next)
            if r.node != before:
                before, filled = r.node, target + 1  # the first child starts a range
            if r.bytes > target or filled + r.bytes > target:
                cuts[prefix + key] = 1
                filled = 0
            filled += r.bytes
            if r.bytes > target:
                filled = target + 1  # so does what follows a heavy one
                if len(key) < 2:
                    cuts[prefix + key] = -(-r.bytes // target)
                else:
                    heavy.append(prefix + _common(bytes(r.low), bytes(r.high)))
        nodes, look = sorted(heavy), min(2 * look, 1 << 16)
    starts = sorted(cuts)
    return Ranges(starts, [cuts[s] for s in starts])
