"""Sharding by a hierarchical weighted hash tree.

Each row descends region, rack and shard. At every level the children draw
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name;
the smallest draw wins. A child's draw depends on nothing but the key, its
name and its weight, so rows move only into or out of subtrees whose weights
change, and a subtree added at the root takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n_shards: int, base: int = 8, racks: int = 2, shards: int = 2) -> list[Leaf]:
    """``base`` shards filled rack by rack; each further shard is a region of its own.

    A new region changes no other subtree's weight, so growing by one shard
    takes rows only into the new one.
    """
    out = []
    for s in range(n_shards):
        if s < base:
            rack = s // shards
            out.append(Leaf(f"region{rack // racks}", f"rack{rack}", s))
        else:
            out.append(Leaf(f"region+{s}", f"rack+{s}", s))
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.xxhash64(key, F.lit(name)).bitwiseAND(F.lit((1 << 52) - 1))
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of ``key``: a weighted hash draw at each level of the tree (null keys hash as null)."""
    def pick(nodes: list[tuple[str, float, Column]]) -> Column:
        if len(nodes) == 1:
            return nodes[0][2]
        draws = [_draw(key, n, w) for n, w, _ in nodes]
        best = F.least(*draws)
        out = nodes[-1][2]
        for d, (_, _, then) in reversed(list(zip(draws, nodes))[:-1]):
            out = F.when(d == best, then).otherwise(out)
        return out

    if not leaves or any(x.weight <= 0 for x in leaves):
        raise ValueError("every shard needs a positive weight")
    if len({x.shard for x in leaves}) != len(leaves):
        raise ValueError("shard numbers repeat")
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for x in leaves:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    return pick([(f"region/{r}", sum(x.weight for v in rk.values() for x in v), pick([
        (f"rack/{r}/{k}", sum(x.weight for x in v), pick([
            (f"shard/{r}/{k}/{x.shard}", x.weight, F.lit(x.shard)) for x in v])) for k, v in rk.items()]))
        for r, rk in regions.items()])


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, size, text_crc32, shard, slot and grown_shard.

    The shard depends on the id and the tree alone. Size is the UTF-8 length
    plus one; a null text has no bytes (size 1, crc32 0); null ids are placed
    like one key. Repeated rows each get a slot. Slots number a shard's rows
    from 0 without gaps: rows are written once, each written part of a shard
    is numbered by itself, and the parts' sizes give the offsets, so no task
    holds a shard. Other columns of ``docs`` are not read. Empty tables give
    no rows. All native expressions.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    rows = written(docs.select(
        key.alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), place(key, leaves).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        # a row's part and its place there, fixed by the write below
        F.monotonically_increasing_id().alias("_at")), "shards")
    # high bits: the writing task; the next bits cut a long task's rows into parts
    part = F.shiftright(F.col("_at"), 16)
    numbered = rows.withColumn("_part", part).withColumn(
        "_n", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_at")))
    sizes = rows.groupBy("shard", part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return numbered.join(offsets, ["shard", "_part"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("_before") + F.col("_n") - 1).alias("slot"), "grown_shard")
