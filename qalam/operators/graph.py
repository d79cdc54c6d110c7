"""Connected components of a link table, and the greedy keep-first choice on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Nodes that a task joins up before it hands on what it has.
BLOCK_NODES = 500_000


def _root(up: dict, x):
    while (p := up.get(x, x)) != x:
        up[x] = up.get(p, p)
        x = p
    return x


def _stars(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each partition's links as stars: every node with the smallest node it is joined with there."""
    up: dict = {}
    for pdf in blocks:
        for a, b in zip(pdf.u.tolist(), pdf.v.tolist()):
            a, b = _root(up, a), _root(up, b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > BLOCK_NODES:
            yield pd.DataFrame([(x, _root(up, x)) for x in list(up)], columns=["u", "v"])
            up = {}
    if up:
        yield pd.DataFrame([(x, _root(up, x)) for x in list(up)], columns=["u", "v"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, root)`` for every node with a link; root is the smallest node of its component.

    Partitions first join up their own links, dealt by ranges of the larger
    node, so long chains shrink to a few stars; then large-star and
    small-star steps alternate until nothing changes, in rounds that grow
    with the logarithm of the chains that are left.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    kind = dict(edges.dtypes)[u]
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v")
    cur = pairs.repartitionByRange("u").mapInPandas(_stars, f"u {kind}, v {kind}").checkpoint()
    seen = None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = low.select("u", F.col("m").alias("v")).unionAll(small).distinct().checkpoint()
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def dropped_in_order(edges: DataFrame) -> DataFrame:
    """Nodes that the greedy scan drops, from links ``(root, i, j)``, i < j, each component in one task.

    Links come sorted by (root, i): when a link is read, the fate of i is
    known, as all links to smaller nodes have been read. So a task holds the
    dropped nodes of one component and no links.
    """
    kind = dict(edges.dtypes)["j"]

    def scan(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, gone = None, set()
        for pdf in blocks:
            out = []
            for r, i, j in zip(pdf.root.tolist(), pdf.i.tolist(), pdf.j.tolist()):
                if r != root:
                    root, gone = r, set()
                if i not in gone and j not in gone:
                    gone.add(j)
                    out.append(j)
            yield pd.DataFrame({"id": out}, dtype=pdf.j.dtype)
    return edges.repartition("root").sortWithinPartitions("root", "i", "j").mapInPandas(scan, f"id {kind}")
