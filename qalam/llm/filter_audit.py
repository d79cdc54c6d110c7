"""Filter interaction audit: what each filter removes in every order, with exact copies found by radix text tries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tries import Ranges, Trie, prefix_ranges

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COPY = 1 << FILTERS.index("E")
#: A task folds the copies among texts of this many bytes before they are dealt out.
BLOCK_BYTES = 16 << 20
_UPPER, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_JUNK = re.compile(rb"[#$%&*|]")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # bytes split at 0x20 and 0x09 to 0x0D
    points = len(text.translate(None, _CONTINUED))
    upper = len(text) - len(text.translate(None, _UPPER))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2
            | (_JUNK.search(text) is not None) << 3)


class _Out:
    """Rows of the audit on their way: those with a text are still open, the others' masks are final."""
    SCHEMA = "_id {id}, part string, mask int, n long, _text binary, slot int"

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, id_, part: str, mask: int, n: int, text: bytes | None, slot: int) -> None:
        self.rows.append((id_, part, mask, n, text, slot))
        self.size += 64 + len(text or b"")

    def full(self) -> bool:
        return self.size > 4 << 20

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = list(zip(*self.rows))
            kinds = (self.id_type, pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["_id", "part", "mask", "n", "_text", "slot"])
        self.rows, self.size = [], 0


class _Fold:
    """A trie whose terminals hold the smallest id of their text, the text's mask, and the rows with that id by part."""

    def __init__(self, out: _Out, slots: int):
        self.out, self.slots, self.trie, self.size = out, slots, Trie(), 0

    def put(self, text: bytes, id_, part: str, n: int, mask: int | None) -> None:
        node = self.trie.terminal(text)
        if node.rows is None:
            node.rows = (id_, text_mask(text) if mask is None else mask, {part: n})
            self.size += len(text) + 200
            return
        least, mask, firsts = node.rows
        if id_ == least:
            firsts[part] = firsts.get(part, 0) + n
        elif id_ > least:
            self.copy(id_, part, mask, n)
        else:
            for p, k in firsts.items():
                self.copy(least, p, mask, k)
            node.rows = (id_, mask, {part: n})

    def copy(self, id_, part: str, mask: int, n: int) -> None:
        self.out.add(id_, part, mask | COPY, n, None, zlib.crc32(f"{id_}".encode()) % self.slots)


def _fold_blocks(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """Texts of a block of a task folded in a trie: one open row for each text (and part), copies with their masks."""
    out = fold = None
    slots, block = ranges.first[-1], 0
    for batch in batches:
        out = out or _Out(batch.schema.field("_id").type)
        fold = fold or _Fold(out, slots)
        ids, parts = (batch.column(c).to_pylist() for c in ("_id", "part"))
        for id_, part, text in zip(ids, parts, batch.column("_text")):
            text = text.as_py()
            if id_ is None:
                out.add(None, part, text_mask(text), 1, None, block % slots)
            else:
                fold.put(text, id_, part, 1, None)
            if out.full():
                yield from out.flush()
        if fold.size > BLOCK_BYTES:
            yield from _open_rows(fold, ranges, block)
            fold, block = _Fold(out, slots), block + 1
    if fold:
        yield from _open_rows(fold, ranges, block)
        yield from out.flush()


def _open_rows(fold: _Fold, ranges: Ranges, block: int) -> Iterator[pa.RecordBatch]:
    for text, node in fold.trie.terminals():
        least, mask, firsts = node.rows
        r = ranges.of(text)
        slot = ranges.first[r] + zlib.crc32(f"{least} {block}".encode()) % ranges.salts[r]
        for part, n in firsts.items():
            fold.out.add(least, part, mask, n, text, slot)
        if fold.out.full():
            yield from fold.out.flush()


def _settle(batches: Iterator[pa.RecordBatch], ranges: Ranges, last: bool) -> Iterator[pa.RecordBatch]:
    """The tries of the ranges of a task, one after the other; rows come sorted by slot.

    In a salted range the terminals of a salt stay open, for a second trie
    over the salts' few survivors (``last``).
    """
    out = fold = at = None

    def traverse() -> Iterator[pa.RecordBatch]:
        for text, node in fold.trie.terminals():
            least, mask, firsts = node.rows
            r = ranges.of(text)
            still = not last and ranges.salts[r] > 1
            for part, n in firsts.items():
                out.add(least, part, mask, n, text if still else None, ranges.first[r] if still else at)
            if out.full():
                yield from out.flush()

    for batch in batches:
        out = out or _Out(batch.schema.field("_id").type)
        ids, parts, masks, counts, slots = (batch.column(c).to_pylist() for c in ("_id", "part", "mask", "n", "slot"))
        for id_, part, mask, n, text, slot in zip(ids, parts, masks, counts, batch.column("_text"), slots):
            if slot != at:
                if fold:
                    yield from traverse()
                fold, at = _Fold(out, ranges.first[-1]), slot
            if text.is_valid:
                fold.put(text.as_py(), id_, part, n, mask)
            else:
                out.add(id_, part, mask, n, None, slot)
            if out.full():
                yield from out.flush()
    if fold:
        yield from traverse()
        yield from out.flush()


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          ranges: Ranges | None = None) -> DataFrame:
    """``(_id, part, mask, n)``: the filters that n equal rows fail, bit i for the i-th letter of :data:`FILTERS`.

    Null texts are empty, null parts the empty string. A row is a copy if a
    smaller id has its text; rows that repeat an id and text are copies alike
    or not at all, rows with a null id never are.
    """
    id_type = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if ranges is None:
        ranges = prefix_ranges(docs, text)
    schema = _Out.SCHEMA.format(id=id_type)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.cast("binary").alias("_text")).mapInArrow(lambda b: _fold_blocks(b, ranges), schema)
    dealt = lambda df: df.repartitionById(ranges.first[-1], F.col("slot")).sortWithinPartitions("slot")
    salted = max(ranges.salts) > 1
    rows = dealt(rows).mapInArrow(lambda b: _settle(b, ranges, not salted), schema)
    if salted:
        rows = dealt(rows).mapInArrow(lambda b: _settle(b, ranges, True), schema)
    return rows.select("_id", "part", "mask", "n")


def mask_counts(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality",
                toxic_col: str = "toxic") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and failed filters, and those that a label marks 1.

    Of several labels of an id a 1 counts; null labels and ids mark nothing.
    """
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(
        one(good_col).alias("_good"), one(toxic_col).alias("_toxic"))
    marked = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return found.join(marks, F.col("_id") == F.col("_of"), "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), marked("_good").alias("good"), marked("_toxic").alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """Each part's documents kept, removed and so on by every step of every order of the filters.

    Computed from the counts by mask, at most 32 rows a part. In the 120
    orders a document that fails k filters is removed by each of them 120 / k
    times, which gives ``shapley``.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * len(FILTERS) - 1)))
    rows = counts.withColumn("_i", at).withColumns({
        "filter_order": F.element_at(F.lit(ORDERS), F.floor(F.col("_i") / len(FILTERS)).cast("int") + 1),
        "step": (F.col("_i") % len(FILTERS) + 1).cast("int")})
    before = F.lit(0)
    for i, letter in enumerate(FILTERS):
        before = before + F.when(F.instr("filter_order", letter) < F.col("step"), 1 << i).otherwise(0)
    own = F.lit(0)
    for i, letter in enumerate(FILTERS):
        own = own + F.when(F.instr("filter_order", letter) == F.col("step"), 1 << i).otherwise(0)
    rows = rows.withColumns({"_fails": F.col("mask").bitwiseAND(own) != 0, "_gone": F.col("mask").bitwiseAND(before) != 0,
                             "_only": F.col("mask") == own})
    count = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0))).cast("long")
    fails, gone = F.col("_fails"), F.col("_gone")
    times = F.when(fails, F.col("n") * F.floor(F.lit(len(ORDERS)) / F.bit_count("mask"))).otherwise(F.lit(0))
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"), count(F.col("_only")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(times).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; an empty table has no parts and gives no rows.

    See :func:`masks` for nulls, ties and repeated rows, :func:`mask_counts` for labels.
    """
    return orders(mask_counts(masks(docs, id_col, text_col, part_col), labels, id_col))
