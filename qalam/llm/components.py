"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


class Forest:
    """Union-find over hashable ids; the smallest id of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(edges: DataFrame) -> DataFrame:
    """Of each partition's edges only a spanning forest: fewer rows, same components.

    Works in blocks of edges, so a task holds one block and its forest.
    """
    def reduce(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, kept = Forest(), []
        for pdf in blocks:
            kept += [(u, v) for u, v in zip(pdf.u.tolist(), pdf.v.tolist()) if sets.join(u, v)]
            if len(kept) > 200_000:
                yield pd.DataFrame(kept, columns=["u", "v"])
                sets, kept = Forest(), []
        yield pd.DataFrame(kept, columns=["u", "v"], dtype="int64")

    return edges.mapInPandas(reduce, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link; root is the smallest node of its component.

    ``edges`` has long columns u and v without nulls; loops and repeats are
    ignored. Large-star and small-star steps alternate until nothing changes:
    each is an aggregate and a join by node, so a hub's links are spread by
    AQE's skew handling. Rounds grow with the logarithm of the longest chain.
    """
    cur = written(forest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .where("u > v")).distinct(), "links")
    seen = None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(low.select("u", F.col("m").alias("v")).unionAll(small).distinct(), "links")
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
