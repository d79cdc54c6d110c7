"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most
sqrt(2 - 2c). The vectors of a label are cut into cells around pivots and
cells into chunks of bounded size; each chunk gets a cover tree (nested
levels with halving radii). Cell pairs, then node pairs, are pruned where
their centres lie further apart than the covering radii and the threshold
allow, and taken whole where all their points must be close enough; what
remains is compared point by point in double precision.

The chunks of a label lie in blocks of about the square root of their
number. A task holds the trees of one block and meets those of another one
after the other, so C chunks cross the shuffle about C * sqrt(C) times, not
twice per pair of chunks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written
from .components import components

CHUNK = 4096
PIVOTS = 64
LEAF = 32
#: Vectors of a block's trees that a task holds at a time, in bytes of doubles.
BLOCK_BYTES = 64 << 20
#: Slack of the bounds against rounding; pairs within it are compared exactly. A distance of near 0 comes
#: from a cosine, so it may be off by the root of a double's precision.
EPS = 1e-7


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class CoverTree:
    """Nodes over a permuted block of unit vectors; a node's points are contiguous.

    node: centre (row), radius (largest distance to its points), points
    [lo, hi), children [first, last) or none for a leaf.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.order: list[int] = []
        self.nodes: list[list] = []
        x = x + 0.0
        self.nodes.append(None)
        self._build(x, np.arange(len(x)), 0, 0, 2.0)
        order = np.array(self.order, np.int64)
        self.order = order
        self.x = x[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.centre = place[np.array([n[0] for n in self.nodes], np.int64)]
        self.radius = np.array([n[1] for n in self.nodes])
        self.lo, self.hi, self.first, self.last = (np.array([n[i] for n in self.nodes], np.int64) for i in (2, 3, 4, 5))
        del self.nodes

    def _build(self, x: np.ndarray, rows: np.ndarray, centre: int, at: int, level: float) -> None:
        stack = [(rows, centre, at, level)]
        while stack:  # depth-first, a node's children in one run of ids
            rows, centre, at, level = stack.pop()
            far = np.sqrt(np.maximum(0, 2 - 2 * (x[rows] @ x[centre])))
            radius = float(far.max())
            lo = len(self.order)
            if len(rows) <= self.leaf or radius < 1e-6:
                self.order.extend(rows.tolist())
                self.nodes[at] = [centre, radius, lo, lo + len(rows), 0, 0]
                continue
            while level >= radius:
                level /= 2
            left, children = rows, []
            while len(left):  # greedy cover: every point goes to the first centre within the level
                c = centre if not children else int(left[0])
                near = 2 - 2 * (x[left] @ x[c]) <= level * level
                near[left == c] = True
                children.append((left[near], c))
                left = left[~near]
            first = len(self.nodes)
            self.nodes.extend([None] * len(children))
            self.nodes[at] = [centre, radius, -1, -1, first, first + len(children)]
            for k, (own, c) in reversed(list(enumerate(children))):
                stack.append((own, c, first + k, level))
        for n in reversed(self.nodes):  # inner nodes span their children's points
            if n[2] < 0:
                n[2], n[3] = self.nodes[n[4]][2], self.nodes[n[5] - 1][3]


def close_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[slice, slice, np.ndarray | None]]:
    """Blocks of point pairs of two trees that hold every pair with the cosine.

    Yields (points of a, points of b, mask); mask None: all pairs of the
    block. With ``a is b`` a block on the diagonal has both slices equal, and
    each other pair comes once.
    """
    t = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        same = a is b and i == j
        ci = np.arange(a.first[i], a.last[i]) if a.last[i] else np.array([i])
        cj = np.arange(b.first[j], b.last[j]) if b.last[j] else np.array([j])
        if not a.last[i] and not b.last[j]:
            pi, pj = slice(a.lo[i], a.hi[i]), slice(b.lo[j], b.hi[j])
            mask = a.x[pi] @ b.x[pj].T >= cosine
            if mask.any():
                yield pi, pj, mask
            continue
        for s in range(0, len(ci), 256):
            own = ci[s:s + 256]
            d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centre[own]] @ b.x[b.centre[cj]].T)))
            spread = a.radius[own][:, None] + b.radius[cj][None, :]
            hit = d - spread <= t + EPS
            if same:
                hit &= own[:, None] <= cj[None, :]
            p, q = np.nonzero(hit)
            whole = (d + spread)[p, q] <= t - EPS
            for u, v, w in zip(own[p].tolist(), cj[q].tolist(), whole.tolist()):
                if w or (a is b and u == v and 2 * a.radius[u] <= t - EPS):
                    yield slice(a.lo[u], a.hi[u]), slice(b.lo[v], b.hi[v]), None
                else:
                    stack.append((u, v))


def link(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, cosine: float):
    """Summed weights of each point's partners in the other tree, and a component label of every point.

    Links inside the pair of trees are folded into the labels as they come,
    so the work holds one block and two arrays. Labels are positions in a's
    points followed by b's (by a's alone if ``a is b``).
    """
    same, n = a is b, len(a.x)
    na, nb = np.zeros(n), np.zeros(len(b.x))
    up = np.arange(n if same else n + len(b.x))
    shift = 0 if same else n

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    def join(u: int, v: int) -> None:
        u, v = root(u), root(v)
        if u != v:
            up[max(u, v)] = min(u, v)

    for pi, pj, mask in close_pairs(a, b, cosine):
        diagonal = same and pi == pj
        if mask is None:
            na[pi] += wb[pj].sum() - (wb[pj] if diagonal else 0)
            if not diagonal:
                nb[pj] += wa[pi].sum()
            for v in range(pj.start, pj.stop):
                join(pi.start, shift + v)
            for u in range(pi.start, pi.stop):
                join(u, shift + pj.start)
            continue
        if diagonal:
            mask = mask.copy()
            np.fill_diagonal(mask, False)
        na[pi] += mask @ wb[pj]
        if not diagonal:
            nb[pj] += mask.T @ wa[pi]
        for u, v in zip(*(k.tolist() for k in np.nonzero(mask))):
            join(pi.start + u, shift + pj.start + v)
    if same:
        na += nb
    return na, nb, np.array([root(v) for v in range(len(up))], np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", chunk: int = CHUNK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal non-null label (and dimension) link at ``cosine`` or
    more. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing. n_links counts the other rows linked
    directly, copies included; component_id is the smallest id reachable; a
    null id takes part but names no component (null if there is no other)
    and is not kept. Equal vectors of a label are compared once. Other
    columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    x = F.col("_x")
    # no aggregate over all components: nulls, NaN and infinity show in the sum of squares
    norm = F.aggregate(x, F.lit(0.0).cast("double"), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = written(vectors.select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_x"),
        F.monotonically_increasing_id().alias("_at")).withColumn("_norm", norm).withColumn(
        "_ok", F.coalesce((F.col("_norm") > 0) & (F.col("_norm") < float("inf")) & ~F.isnan("_norm")
                          & F.col("_label").isNotNull(), F.lit(False))).withColumns(
        # two independent 64-bit hashes stand for a vector
        {"_h": F.xxhash64("_x"), "_g": F.xxhash64(F.lit(1), F.reverse("_x")), "_dim": F.size("_x")}), "vectors")
    key = ["_label", "_dim", "_h", "_g"]
    reps = written(rows.where("_ok").groupBy(*key).agg(
        F.min("_id").alias("_least"), F.count("*").alias("_copies"), F.any_value("_x").alias("_x")).withColumn(
        "_rep", F.monotonically_increasing_id()), "vectors")
    group = ["_label", "_dim"]
    sizes = reps.groupBy(*group).agg(F.count("*").alias("_n"))
    slices = _celled(reps, sizes, group, chunk)
    cells = slices.groupBy(*group, "_cell").agg(F.max("_far").alias("_radius"), F.count("*").alias("_m"),
                                                F.any_value("_pivot").alias("_pivot"))
    cells = written(cells.withColumn("_chunks", F.ceil(F.col("_m") / chunk).cast("int")), "cells")
    chunked = slices.join(cells.select(*group, "_cell", "_chunks"), [*group, "_cell"]).withColumn(
        "_sub", F.pmod(F.xxhash64("_rep"), F.col("_chunks")))

    def plant(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rep")
        tree = CoverTree(unit(list(pdf["_x"])))
        own = (tree, pdf["_rep"].to_numpy()[tree.order], pdf["_copies"].to_numpy()[tree.order].astype(float))
        return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "_cell": [int(key[1])], "_sub": [int(key[2])],
                             "_tree": [pickle.dumps(own, protocol=5)]})

    # a group's hash stands for its label of whatever type; label and dimension together make 128 bits
    named = chunked.withColumn("_group", F.concat_ws("/", F.hex(F.xxhash64(*group)), F.hex(F.xxhash64(F.lit(1), *group))))
    trees = written(named.select("_group", "_cell", "_sub", "_rep", "_copies", "_x").groupBy(
        "_group", "_cell", "_sub").applyInPandas(plant, "_group string, _cell int, _sub long, _tree binary"), "trees")
    met_trees = _met_trees(trees, cells, group, chunk, float(np.sqrt(max(0.0, 2 - 2 * cosine))))

    def links(left: tuple, right: tuple) -> Iterator[pd.DataFrame]:
        (a, ra, wa), (b, rb, wb) = left, right
        na, nb, label = link(a, b, wa, wb, cosine)
        n, rep = (na, ra) if b is a else (np.concatenate([na, nb]), np.concatenate([ra, rb]))
        hit = n > 0
        if hit.any():
            yield pd.DataFrame({"u": rep[hit], "v": rep[label[hit]], "n": n[hit].astype(np.int64)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, []  # the pair of blocks at hand, and the trees of its first block
        for pdf in batches:
            for *pair, second, cell, near, tree in zip(*(pdf[c] for c in MET)):
                if pair != at:
                    at, block = pair, []
                own, tree = pair[1] == pair[2], pickle.loads(tree)
                if own or second:
                    near = set(near.tolist())
                    for c, left in block:
                        if c * PIVOTS + cell in near:
                            yield from links(left, tree)
                if own:
                    yield from links(tree, tree)
                if not second:
                    block.append((cell, tree))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a tree a row
    met = written(met_trees.mapInPandas(meet, "u long, v long, n long"), "links")
    prepare(spark)
    partners = met.groupBy(F.col("u").alias("_rep")).agg(F.sum("n").alias("_n"))
    roots = components(met.select("u", "v")).withColumnRenamed("node", "_rep")
    named = reps.select(*key, "_rep", "_least", "_copies").join(roots, "_rep", "left").join(
        partners, "_rep", "left").withColumn("_root", F.coalesce("root", "_rep"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    known = named.join(least, "_root").select(*key, "component_id", (
        F.coalesce("_n", F.lit(0)) + F.col("_copies") - 1).alias("n_links"))
    linked = rows.where("_ok").select("_id", *key).join(known, key).select("_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionAll(alone).select(
        F.col("_id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _celled(reps: DataFrame, sizes: DataFrame, group: list[str], chunk: int) -> DataFrame:
    """Each vector with the nearest pivot of its group, in slices of bounded size.

    A group of up to ``chunk`` vectors is one cell. A larger one gets a pivot
    per chunk, PIVOTS at most: those with the smallest hashes, found by a
    bounded aggregate.
    """
    sized = reps.join(sizes, group)
    ranked = F.struct(F.col("_h"), F.col("_g"), F.col("_x"))
    # min_by over salted parts first, so that no task gathers a group
    part = F.pmod(F.col("_g"), F.lit(PIVOTS))
    picked = sized.where(F.col("_n") > chunk).withColumn("_part", part).where(
        part < F.ceil(F.col("_n") / chunk)).groupBy(*group, "_part").agg(F.min(ranked).alias("_p"))
    pivots = picked.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_part", F.col("_p._x").alias("x")))).alias("_pivots"))
    slices = sized.withColumn("_slice", F.pmod(F.xxhash64(F.lit(7), "_rep"), F.ceil(F.col("_n") / chunk)))
    wide = written(sizes.join(pivots, group, "left").withColumn("_slice", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("_n") / chunk) - 1))).select(*group, "_slice", "_pivots"), "pivots")

    def assign(own: pd.DataFrame, piv: pd.DataFrame) -> pd.DataFrame:
        x = unit(list(own["_x"]))
        found = piv["_pivots"].iloc[0] if len(piv) else None
        if found is None or len(found) == 0:
            p = x[:1] * 0
            cell, far = np.zeros(len(x), int), np.full(len(x), 2.0)
        else:
            p = unit([r["x"] for r in found])
            d = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
            cell = d.argmin(axis=1)
            far = d[np.arange(len(x)), cell]
        out = own.drop(columns=["_slice", "_n", "_h", "_g", "_least"])
        return out.assign(_cell=cell.astype(np.int32), _far=far, _pivot=[p[c if len(p) > c else 0] for c in cell])

    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, "_copies", "_x", "_rep"])
    keys = [*group, "_slice"]
    return written(slices.select(*group, "_h", "_g", "_least", "_copies", "_x", "_rep", "_n", "_slice").groupBy(*keys).cogroup(
        wide.groupBy(*keys)).applyInPandas(assign, f"{schema}, _cell int, _far double, _pivot array<double>"), "slices")


#: Columns that a task reads of each tree: its pair of blocks, whether it is of the second one, its cell, near cell pairs.
MET = ["_group", "_p", "_q", "_second", "_cell", "_near", "_tree"]


def _blocks(cells: DataFrame, group: list[str], chunk: int, t: float) -> tuple[DataFrame, DataFrame]:
    """Cells with the place of their first chunk and the size of a block, and the pairs of blocks with near cells.

    The chunks of a group are numbered through its cells, at most PIVOTS, and
    cut into blocks. ``_near`` lists the pairs of cells, one of each block,
    that are near enough for a link.
    """
    name = F.concat_ws("/", F.hex(F.xxhash64(*group)), F.hex(F.xxhash64(F.lit(1), *group)))
    whole = Window.partitionBy(*group)  # a row per cell
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    fit = F.floor(F.lit(float(BLOCK_BYTES)) / (F.col("_dim") * (8.0 * chunk)))
    c = cells.withColumns({
        "_from": F.coalesce(F.sum("_chunks").over(before), F.lit(0)),
        "_size": F.greatest(F.lit(1), F.least(F.ceil(F.sqrt(F.sum("_chunks").over(whole))), fit)).cast("long"),
    }).select(name.alias("_group"), "_cell", "_radius", "_pivot", "_size", "_from",
              (F.col("_from") + F.col("_chunks") - 1).alias("_to"))
    a = c.select("_group", "_size", *(F.col(x).alias(f"{x}_a") for x in ("_cell", "_radius", "_pivot", "_from", "_to")))
    b = c.select("_group", *(F.col(x).alias(f"{x}_b") for x in ("_cell", "_radius", "_pivot", "_from", "_to")))
    apart = F.sqrt(F.aggregate(F.zip_with("_pivot_a", "_pivot_b", lambda p, q: (p - q) * (p - q)),
                               F.lit(0.0).cast("double"), lambda s, v: s + v))
    near = a.join(b, "_group").where("_cell_a <= _cell_b").where(
        (F.col("_cell_a") == F.col("_cell_b")) | (apart <= F.col("_radius_a") + F.col("_radius_b") + t + EPS))
    blocks = lambda k: F.explode(F.expr(f"sequence(_from_{k} div _size, _to_{k} div _size)"))
    pairs = near.withColumn("_p", blocks("a")).withColumn("_q", blocks("b")).where("_p <= _q").groupBy(
        "_group", "_p", "_q").agg(F.collect_set(F.col("_cell_a") * PIVOTS + F.col("_cell_b")).alias("_near"))
    return c.select("_group", "_cell", "_from", "_size"), pairs


def _met_trees(trees: DataFrame, cells: DataFrame, group: list[str], chunk: int, t: float) -> DataFrame:
    """The trees of each pair of blocks in one partition, those of the first block before those of the second."""
    placed, pairs = _blocks(cells, group, chunk, t)
    pairs = written(pairs, "blocks")
    members = trees.join(placed, ["_group", "_cell"]).withColumn("_block", F.expr("(_from + _sub) div _size")).drop("_from", "_size")
    first = members.withColumnRenamed("_block", "_p").join(pairs, ["_group", "_p"]).withColumn("_second", F.lit(False))
    second = members.withColumnRenamed("_block", "_q").join(pairs.where("_p < _q"), ["_group", "_q"]).withColumn("_second", F.lit(True))
    tasks = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.unionByName(second).repartition(tasks, "_group", "_p", "_q").sortWithinPartitions(
        "_group", "_p", "_q", "_second", "_cell", "_sub").select(*MET)
