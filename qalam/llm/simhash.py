"""SimHash near-duplicates by generalised pigeonhole search in Hamming space.

The 64 bits are grouped into ``m`` parts, correlated bits together. With part
thresholds e_i >= -1 (-1: part not probed) whose sum of (e_i + 1) is
``max_bits + 1``, any pair within ``max_bits`` differs by at most e_i bits in
some part i. Each fingerprint gets its own thresholds from a dynamic
programme over estimated candidate counts, probes the parts' index, and is
verified on all bits. Fingerprints whose cheapest plan still has very many
candidates -- they sit in one dense cluster -- are linked with each other
through keys one and two flips away, which takes a fixed number of rows each
and keeps every component (see :func:`_dense_links`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

BITS = 64
#: Candidates beyond which a fingerprint counts as dense: estimated ones, or the true ones of one key.
DENSE = 1024
#: A part's value enters the estimate by its count if that is at least this share of all rows.
HEAVY_SHARE = 1 / 20_000
SHINGLE_BLOCK = 1 << 16


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles of a text, repeats included.

    A-Z are lower-cased; words are runs of bytes other than ASCII white
    space; fewer than k words are one shingle; none give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(flat, 42)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(flat)]])
    n = len(words) - k + 1
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLE_BLOCK):
        b = min(n, at + SHINGLE_BLOCK)
        h = np.array([digest(flat[s:e], 42) for s, e in zip(start[at:b].tolist(), end[at + k - 1:b + k - 1].tolist())],
                     dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per document row."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col), of(F.col(text_col)).alias("fp"))


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` parts of near-equal width from the counts of bit pairs set together; correlated bits together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        pairs = [(-round(float(corr[a, b]), 6), a, b) for a, b in combinations(sorted(left), 2)]
        part = list(min(pairs)[1:])
        while len(part) < width:
            part.append(min(sorted(left - set(part)), key=lambda b: -round(float(corr[b, part].mean()), 6)))
        parts.append(sorted(part[:width]))
        left -= set(parts[-1])
    return parts


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part, packed into the low bits of a long."""
    fp, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out.view(np.int64)


class Plan:
    """Parts, their heavy values, and the thresholds that the estimate gives each fingerprint."""

    def __init__(self, parts: list[list[int]], n: int, heavy: list[dict[int, int]], max_bits: int, top: int = 1):
        self.parts, self.n, self.max_bits = parts, n, max_bits
        #: Largest threshold of a part; the sum must be reachable.
        self.top = max(top, -(-(max_bits + 1) // len(parts)) - 1)
        self.heavy = [(np.array(sorted(h), np.int64), np.array([h[v] for v in sorted(h)], float)) for h in heavy]

    def _count(self, i: int, values: np.ndarray) -> np.ndarray:
        keys, counts = self.heavy[i]
        base = self.n / float(1 << len(self.parts[i]))
        if not len(keys):
            return np.full(len(values), base)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[at] == values, counts[at], base)

    @staticmethod
    def flips(width: int, radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)],
                        np.int64)

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """Probes and estimated candidates: [part, threshold + 1, fingerprint]."""
        out = np.zeros((len(self.parts), self.top + 2, len(fp)))
        for i, bits in enumerate(self.parts):
            v = gather(fp, bits)
            for e in range(self.top + 1):
                for mask in self.flips(len(bits), e):
                    out[i, e + 1] += 1 + self._count(i, v ^ mask)
        return out

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cheapest thresholds [part, fingerprint] and their cost, by dynamic programming over the parts."""
        cost, want = self.costs(fp), self.max_bits + 1
        best = np.full((want + 1, len(fp)), np.inf)
        best[0] = 0
        picks = []
        for i in range(len(self.parts)):
            nxt, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for used in range(self.top + 2):
                for total in range(used, want + 1):
                    c = best[total - used] + cost[i, used]
                    better = c < nxt[total]
                    nxt[total][better], pick[total][better] = c[better], used
            best = nxt
            picks.append(pick)
        e, left, who = np.zeros((len(self.parts), len(fp)), np.int8), np.full(len(fp), want), np.arange(len(fp))
        for i in reversed(range(len(self.parts))):
            e[i] = picks[i][left, who]
            left = left - e[i]
        return e - 1, best[want]


def _parts_for(n: int, max_bits: int) -> int:
    """The number of parts with the least probes and candidates if bits were even."""
    def cost(m: int) -> float:
        width, left, total = BITS // m, max_bits + 1, 0.0
        for i in range(m):
            e = -(-left // (m - i)) - 1
            left -= e + 1
            ball = len(Plan.flips(width, e)) if e >= 0 else 0
            total += ball * (1 + n / 2.0 ** width)
        return total

    return min(range(max(1, (max_bits + 2) // 2), max_bits + 2), key=cost)


def _plan(fps: DataFrame, max_bits: int) -> Plan:
    """Reads the fingerprints twice: counts of bit pairs (64 x 64), then the parts' heavy values.

    What comes to the driver is bounded: 4,096 sums, and at most
    1 / HEAVY_SHARE values a part.
    """
    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for pdf in batches:
            h = pdf["fp"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(h, axis=1)[:, ::-1].astype(np.float32)
            total, n = total + bits.T @ bits, n + len(pdf)
        if n:
            yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "k": np.append(total.ravel(), n).astype(np.int64)})

    sums = {r["at"]: r["k"] for r in fps.mapInPandas(together, "at int, k long").groupBy("at").agg(
        F.sum("k").alias("k")).collect()}
    n = sums.get(BITS * BITS, 0)
    both = np.array([sums.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)
    parts = group_bits(both, n, _parts_for(n, max_bits))
    least = max(8, int(n * HEAVY_SHARE))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            yield pd.DataFrame({"part": np.repeat(np.arange(len(parts), dtype=np.int32), len(fp)),
                                "value": np.concatenate([gather(fp, b) for b in parts])})

    heavy: list[dict[int, int]] = [{} for _ in parts]
    for r in fps.mapInPandas(values, "part int, value long").groupBy("part", "value").agg(
            F.count("*").alias("n")).where(F.col("n") >= least).collect():
        heavy[r["part"]][r["value"]] = r["n"]
    return Plan(parts, n, heavy, max_bits)


def _key(part: int, value: np.ndarray) -> np.ndarray:
    # parts are at most 32 bits wide for the thresholds in use
    return (np.int64(part) << np.int64(48)) ^ value


def links(fps: DataFrame, max_bits: int = 3, dense: int = DENSE) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fps.fp``: every pair within ``max_bits``.

    Pairs of two dense fingerprints come as a set of links with the same
    components instead; all links returned are within ``max_bits``.
    """
    plan = _plan(fps, max_bits)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for i, bits in enumerate(plan.parts):
                yield pd.DataFrame({"key": _key(i, gather(fp, bits)), "v": fp})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            e, cost = plan.thresholds(fp)
            cold = cost <= dense
            if not cold.all():
                yield pd.DataFrame({"key": np.int64(-1), "u": fp[~cold]})
            for i, bits in enumerate(plan.parts):
                v = gather(fp, bits)
                for r in range(plan.top + 1):
                    who = cold & (e[i] == r)
                    for mask in plan.flips(len(bits), r) if who.any() else ():
                        yield pd.DataFrame({"key": _key(i, v[who] ^ mask), "u": fp[who]})

    probes = written(fps.mapInPandas(probe, "key long, u long"), "probes")
    entries = fps.mapInPandas(index, "key long, v long")
    hot = probes.where("key = -1").select(F.col("u").alias("fp"))
    cold = probes.where("key >= 0")
    # keys that the estimate took for small: whoever probes one is dense after all
    crowds = written(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("key"), "crowds")
    if not crowds.isEmpty():
        late = written(cold.join(crowds, "key", "left_semi").select(F.col("u").alias("fp")).distinct(), "crowded")
        hot = hot.unionAll(late)
        cold = cold.join(late, cold["u"] == late["fp"], "left_anti")
    found = cold.join(entries, "key").where(F.col("u") != F.col("v")).where(
        F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")
    return found if hot.isEmpty() else found.unionAll(_dense_links(hot, max_bits))


def _dense_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links between dense fingerprints with all their components, in a fixed number of rows each.

    With a = max_bits // 2 and b = max_bits - a, a pair within ``max_bits``
    has a key within a flips of one and b flips of the other. Under each key
    the smallest fingerprint within a flips is linked with every one within
    b flips: such a link spans at most a + b bits, and it joins every pair
    that meets under the key.
    """
    a, b = max_bits // 2, max_bits - max_bits // 2

    def ball(radius: int):
        masks = Plan.flips(32, 0) if radius == 0 else np.array(
            [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(BITS), r)],
            np.uint64).view(np.int64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                fp = pdf["fp"].to_numpy()
                for at in range(0, len(fp), 64):
                    own = fp[at:at + 64]
                    yield pd.DataFrame({"key": (own[:, None] ^ masks[None, :]).ravel(),
                                        "fp": np.repeat(own, len(masks))})
        return run

    centre = fps.mapInPandas(ball(a), "key long, fp long").groupBy("key").agg(F.min("fp").alias("u"))
    around = fps.mapInPandas(ball(b), "key long, fp long").select("key", F.col("fp").alias("v"))
    return centre.join(around, "key").where("u <> v").select("u", "v")


def near_duplicates(docs: DataFrame, k: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document row: id, fp (signed long), component_id.

    Documents link when their fingerprints differ in at most ``max_bits``
    bits; component_id is the smallest id reachable over links. Equal
    fingerprints are searched once. Null and empty texts have fingerprint 0
    and link like any other. A null id takes part but is never a
    component_id (null if a component has no other). Other columns are not read.
    """
    rows = written(fingerprints(docs, k, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    by_fp = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_fp.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, k: int = 3, max_bits: int = 3, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Of repeated rows with that id one stays. Where no row of a group has an
    id, one of its rows stays. All columns stay.
    """
    at = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_at")), "documents")
    key = F.col("_doc").getField(id_col)
    seen = near_duplicates(at.select(F.struct(key.isNull().alias("none"), key.alias("id"), "_at").alias("_id"),
                                     F.col("_doc").getField(text_col).alias("_text")), k, max_bits, "_id", "_text")
    stay = seen.where(F.col("component_id") == F.col("_id")).select(F.col("_id._at").alias("_at"))
    return at.join(stay, "_at").select("_doc.*")
