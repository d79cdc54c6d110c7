"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Test items are grouped by the number of their distinct shingles (powers of
two). An item's sketch is its smallest shingle hashes; a group's sketch size
is the least with which *any* document containing the asked share of an item
of that group must contain a sketch member, so the search misses nothing. A
document's own size does not enter, so a short item is found in a document
of any length. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, HashSet, shingle_hashes, word_hashes, written

#: Characters of test items that one pass over the documents holds in a task.
BLOCK_CHARS = 32_000_000
_WORD = re.compile(WORD)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(ws: list[str], k: int) -> set[str]:
    """Distinct k-word shingles; a shorter text is one shingle of all its words."""
    if not ws:
        return set()
    return {" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))}


def sketch_size(n: int, similarity: float) -> int:
    """Members that any document holding ``similarity`` of ``n`` shingles cannot all miss."""
    return n - math.ceil(n * similarity - 1e-9) + 1


class Index:
    """Sketches of a block of items, and their shingles for verification."""

    def __init__(self, items: list[tuple], k: int, similarity: float):
        self.k, self.similarity = k, similarity
        self.items: list[tuple] = []
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.lengths = set()
        for key, text in items:
            ws = words(text)
            if own := shingles(ws, k):
                size = min(k, len(ws))
                self.lengths.add(size)
                h = np.unique(shingle_hashes(word_hashes(text), size))
                groups.setdefault(len(own).bit_length(), []).append((len(self.items), h))
                self.items.append((key, own, size))
        self.of: dict[int, list[int]] = {}
        for members in groups.values():
            most = max(sketch_size(len(h), similarity) for _, h in members)
            for i, h in members:
                for x in h[:most].tolist():
                    self.of.setdefault(x, []).append(i)
        self.keys = HashSet(np.array(list(self.of), np.uint64)) if self.of else None

    def search(self, text: str | None) -> list[tuple]:
        """(item, shared shingles, item's shingles) of every item contained in the text."""
        if not text or self.keys is None:
            return []
        hashed, found = word_hashes(text), set()
        for size in self.lengths:
            h = shingle_hashes(hashed, size)
            for x in set(h[self.keys.where(h)].tolist()):
                found.update(i for i in self.of[x] if self.items[i][2] == size)
        out = []
        if found:
            ws = words(text)
            own = {size: shingles(ws, size) for size in {self.items[i][2] for i in found}}
            for i in sorted(found):
                key, want, size = self.items[i]
                shared = len(want & own[size])
                if shared >= self.similarity * len(want) - 1e-9:
                    out.append((key, shared, len(want)))
        return out


def find_items(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, n_shared, n_shingles, containment) for every document row that contains an item.

    Words are runs of ASCII letters, digits and non-ASCII characters of the
    lower-cased text; shingles are distinct runs of ``k`` words. A document
    contains an item if it holds at least ``similarity`` of its shingles. An
    item with fewer words is one shingle of them all; one without words, or
    null, is in no document; a null or empty document contains nothing.
    Repeated documents and items give repeated rows. Items beyond
    ``block_chars`` characters are searched in blocks, one pass over the
    documents each, so a task never holds more than a block.
    """
    kind = items.schema[item_col].dataType.simpleString()
    parts = []
    blocks = _blocks(items, item_col, item_text_col, block_chars)
    for block in blocks:
        hits = _search(block, k, similarity, f"array<struct<item:{kind},copies:bigint,n_shared:bigint,n_shingles:bigint>>",
                       lambda found: [{"item": i, "copies": c, "n_shared": n, "n_shingles": m} for (i, c), n, m in found])
        found = docs.select(F.col(id_col).alias("_id"), F.explode(hits(F.col(text_col))).alias("_hit"))
        if len(blocks) > 1:  # one block at a time: its findings are kept, its items go
            found = written(found, "items-found")
            block.unpersist()
        parts.append(found)
    out = reduce(DataFrame.unionAll, parts)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_hit.copies"))))
    return out.select(F.col("_id").alias(id_col), F.col("_hit.item").alias(item_col), "_hit.n_shared", "_hit.n_shingles",
                      (F.col("_hit.n_shared") / F.col("_hit.n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8,
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no item, in the sense of :func:`find_items`, with all their columns."""
    blocks = _blocks(items, item_col, item_text_col, block_chars)
    for block in blocks:
        docs = docs.where(_search(block, k, similarity, "boolean", lambda found: not found)(F.col(text_col)))
        if len(blocks) > 1:
            docs = written(docs, "without-items")
            block.unpersist()
    return docs


class Block:
    """Test items of about a block's size in the shared folder; collected and broadcast when first searched, until let go."""

    def __init__(self, items: DataFrame):
        self.items, self.sent = items, None

    def send(self):
        if self.sent is None:
            rows = [((r["item"], r["copies"]), r["text"]) for r in self.items.collect()]
            self.sent = self.items.sparkSession.sparkContext.broadcast(rows)
        return self.sent

    def unpersist(self) -> None:
        if self.sent is not None:
            self.sent.unpersist()
            self.sent = None


def _search(block: Block, k: int, similarity: float, kind: str, say):
    """A UDF over texts: what ``say`` makes of a text's hits; a task builds the index of its block once."""
    sent = block.send()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(sent.value, k, similarity)
        for texts in batches:
            yield pd.Series([say(index.search(t)) for t in texts], dtype=object)

    return F.pandas_udf(run, kind)


def _blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> list[Block]:
    """The items in blocks of about ``block_chars`` characters, equal (item, text) rows folded to one with their number.

    Folded items are dealt to twice as many blocks as their characters need,
    by hash, so a block stays near half the bound.
    """
    folded = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").groupBy(
        "item", "text").agg(F.count(F.lit(1)).alias("copies"))
    total = folded.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    if total <= block_chars:
        return [Block(folded)]
    n = -(-2 * total // block_chars)
    folded = written(folded.withColumn("_b", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "items")
    return [Block(folded.where(F.col("_b") == b)) for b in range(n)]
