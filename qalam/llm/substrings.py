"""Removal of repeated byte strings: external suffix sorting over Spark shards.

Any two equal ``width``-byte strings choose the same anchor: the ``gram``
bytes with the least hash in them. Only the surroundings of anchors that
occur more than once can hold repeats. Equal surroundings are folded into
one; the different ones of an anchor meet in a shard, whose suffixes are
sorted by induction (:mod:`suffixes`), and neighbours with a common prefix of
``width`` bytes are repeats. Shards are made by bytes, so that their sorts fit
a task; an anchor with more bytes or different surroundings than a shard is
not gathered: its strings are grouped by their hashes in Spark.
"""

from __future__ import annotations

import gc
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import written
from .suffixes import repeated

WIDTH, GRAM = 100, 24
#: Different surroundings that a shard holds, and beyond which an anchor is not gathered.
SHARD_PIECES, HOT_PIECES = 16_384, 16_384
#: Bytes of surroundings that a shard is made for (half of it on average), and beyond which an anchor is not gathered;
#: a sort takes some 60 bytes of memory a byte.
SHARD_BYTES = 8 << 20
#: A long run of an anchor is handled in segments of so many strings.
SEGMENT = 1 << 16
#: Strings whose anchors are chosen at once within a text.
STRIDE = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def _hashes(b: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes."""
    up, down = common._powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(common._MIX[b] * up[:-1], out=total[1:])
    return common._mixed((total[size:] - total[:-size]) * down[:len(b) - size + 1])


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of the anchors of a text; runs of one anchor that overlap in a string are one."""
    b, w = np.frombuffer(data, np.uint8), width - gram + 1
    at, found = [], []
    for lo in range(0, max(0, len(b) - width + 1), STRIDE):
        h = _hashes(b[lo:lo + STRIDE + width - 1], gram)
        # the least hash, of equal ones the last: the low bits hold the place
        key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        blocks = np.full(-(-len(key) // w) * w, ~np.uint64(0))
        blocks[:len(key)] = key
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        place = (_LOW - (np.minimum(back[:n], ahead[w - 1:w - 1 + n]) & _LOW)).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        at.append(place + lo)
        found.append(h[place])
    if not at:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, first = np.unique(np.concatenate(at), return_index=True)
    h = np.concatenate(found)[first]
    new = np.ones(len(place), bool)
    new[1:] = (h[1:] != h[:-1]) | (np.diff(place) > w)
    start = np.flatnonzero(new)
    return h[start], place[start], place[np.append(start[1:], len(place)) - 1]


def surrounding(n: int, first, last, width: int = WIDTH, gram: int = GRAM):
    """[from, to) of all strings of ``width`` bytes that hold the anchor."""
    return np.maximum(first - (width - gram), 0), np.minimum(last + width, n)


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals as sorted maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
             shard_pieces: int = SHARD_PIECES, hot_pieces: int = HOT_PIECES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(_id, _h, lo, hi): intervals of each document whose bytes are to go.

    A document is an id and a text's hash; intervals may overlap.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    id_kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, edges = [], [0]
            for text in batch.column("_text").to_pylist():
                data = _bytes(text)
                h, first, last = anchors(data, width, gram)
                lo, hi = surrounding(len(data), first, last, width, gram)
                digest = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(lo.tolist(), hi.tolist())]
                got.append((h, first | (last - first) << 32, np.array(digest, np.uint64)))
                edges.append(edges[-1] + len(h))
            columns = [pa.array(np.concatenate(c).view(np.int64)) for c in zip(*got)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_h", "_doc")), pa.ListArray.from_arrays(
                pa.array(edges, pa.int32()), pa.StructArray.from_arrays(columns, ["a", "p", "d"]))],
                ["_id", "_h", "_doc", "_anchors"])

    # a row per document; _doc numbers the rows, fixed by this write; p: first place, and above it last - first
    found = written(keyed.select("_id", "_h", F.monotonically_increasing_id().alias("_doc"), "_text").mapInArrow(
        find, f"_id {id_kind}, _h long, _doc long, _anchors array<struct<a:bigint,p:bigint,d:bigint>>"), "anchors")
    rows = found.select("_doc", F.explode("_anchors").alias("_a")).select("_doc", "_a.*")
    more = F.shiftright(F.col("p"), 32).cast("int")
    often = rows.groupBy("a").agg(F.sum(F.when(more > 0, 2).otherwise(1)).alias("n")).where("n > 1").select("a")
    again = written(rows.join(often, "a", "left_semi").join(found.select("_doc", "_id", "_h"), "_doc").select(
        "_id", "_h", "a", F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("first"), more.alias("more"), "d"), "anchors")
    common.dropped(found)
    _settle(spark)
    # documents are ordered by id, null last, then by the text's hash
    order = lambda at: F.struct(F.col("_id").isNull().alias("_none"), "_id", "_h", F.col(at).alias("_at"))
    kinds = written(again.groupBy("a", "d").agg(F.min(order("first")).alias("_first")), "kinds")
    counts = kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1")
    judged = written(again.join(kinds, ["a", "d"]).select(
        "_id", "_h", "a", "first", "more", (order("first") == F.col("_first")).alias("_stays")), "judged")
    common.dropped(again)
    _settle(spark)
    lo = F.greatest(F.col("first") - (width - gram), F.lit(0))
    copies = judged.where("not _stays").select("_id", "_h", lo.alias("lo"), (F.col("first") + F.col("more") + width).alias("hi"))
    # the one that stays of each kind: its strings may repeat in other kinds, or within itself
    stays = judged.where("_stays").join(counts, "a", "left").where("kinds > 1 or more > 0")
    wanted = stays.groupBy("_id", "_h").agg(F.collect_list(F.struct("a", "first", "more", "kinds")).alias("_cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, (text, cuts) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_cuts").to_pylist())):
                data = _bytes(text)
                for c in cuts:
                    s, e = map(int, surrounding(len(data), c["first"], c["first"] + c["more"], width, gram))
                    for x in range(s, max(s + 1, e - width + 1), SEGMENT):  # each string of a long run is in one segment
                        part = data[x:min(e, x + SEGMENT + width - 1)]
                        row.append(i)
                        out.append((c["a"], c["kinds"] or 1, x, max(0, c["first"] - x), c["more"], len(part), part))
            at = pa.array(row, pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(at), batch.column("_h").take(at),
                 *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))],
                ["_id", "_h", "a", "kinds", "lo", "at", "more", "size", "piece"])

    pieces = written(_with(keyed, wanted, "inner").select("_id", "_h", "_text", "_cuts").mapInArrow(
        cut, f"_id {id_kind}, _h long, a long, kinds long, lo int, at int, more int, size int, piece binary"), "pieces")
    _settle(spark)
    weights = pieces.groupBy("a").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("kinds").alias("kinds"))
    is_hot = (F.col("bytes") > shard_bytes) | (F.col("kinds") > hot_pieces)
    total = weights.agg(F.sum(F.when(~is_hot, F.col("bytes"))).alias("bytes"), F.sum(F.when(~is_hot, F.col("n"))).alias("n"),
                        F.count_if(is_hot).alias("hot")).first()
    n_shards = max(1, -(-(total.n or 0) // shard_pieces), -(-2 * (total.bytes or 0) // shard_bytes))
    side = (width - gram + 1) // 2  # a string reaches so far beyond its anchor on one side at least

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [p[i - side:i + gram] if i >= side else None for p, i in zip(pdf["piece"], pdf["at"])]
        right = [p[i:i + gram + side] if len(p) >= i + gram + side else None
                 for p, i in zip(pdf["piece"], pdf["at"] + pdf["more"])]
        sides = [Counter(zip(pdf["a"], x)) for x in (left, right)]
        # a run's sides are read at its ends, but a string may share any of its anchors: no row of such an anchor is judged
        runs = set(pdf["a"][pdf["more"] > 0])
        pdf = pdf[[a in runs or any(x is not None and n[a, x] > 1 for n, x in zip(sides, xs))
                   for a, xs in zip(pdf["a"], zip(left, right))]]
        pdf = pdf.sort_values(["_id", "_h", "lo", "a"], na_position="last").reset_index(drop=True)
        group, piece, offset = repeated(pdf["piece"].tolist(), width)
        if not len(group):
            return pd.DataFrame({"_id": pdf["_id"][:0], "_h": pdf["_h"][:0], "lo": [], "hi": []})
        base, doc = pdf["lo"].to_numpy(np.int64), pdf.groupby(["_id", "_h"], dropna=False, sort=False).ngroup().to_numpy()
        place = (doc[piece].astype(np.int64) << 40) | (base[piece] + offset)
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.repeat(np.minimum.reduceat(place, edge), np.diff(np.append(edge, len(group))))
        late = np.unique(place[place > least])
        new = np.ones(len(late), bool)
        new[1:] = np.diff(late) > width
        start = np.flatnonzero(new)
        lo, hi = late[start], late[np.append(start[1:], len(late)) - 1] + width if len(late) else late
        one = pdf.drop_duplicates(["_id", "_h"]).reset_index(drop=True).iloc[lo >> 40]
        low = (1 << 40) - 1
        return pd.DataFrame({"_id": one["_id"].to_numpy(), "_h": one["_h"].to_numpy(), "lo": lo & low, "hi": hi & low})

    hot = weights.where(is_hot).select("a")
    shards = (pieces.join(hot, "a", "left_anti") if total.hot else pieces).withColumn(
        "_shard", F.pmod(F.xxhash64("a"), F.lit(n_shards)))
    out = written(copies.unionAll(shards.drop("kinds", "size").groupBy("_shard").applyInPandas(
        sort, f"_id {id_kind}, _h long, lo int, hi int")), "intervals")
    if total.hot:
        out = out.unionAll(written(_hot(pieces.join(hot, "a", "left_semi"), width, order), "intervals"))
    common.dropped(judged)
    _settle(spark)
    return out


def _hot(pieces: DataFrame, width: int, order) -> DataFrame:
    """Intervals of anchors with very many kinds: a row per string, grouped by its 128-bit hash."""
    @F.pandas_udf("array<struct<x:bigint,y:bigint>>")
    def strings(own: pd.Series) -> pd.Series:
        return pd.Series([[{"x": xxhash.xxh64_intdigest(p[i:i + width], 1) - (1 << 63),
                            "y": xxhash.xxh64_intdigest(p[i:i + width], 2) - (1 << 63)}
                           for i in range(len(p) - width + 1)] for p in own], dtype=object)

    hot = written(pieces.select("_id", "_h", "lo", F.posexplode(strings("piece")).alias("_i", "_s")).select(
        "_id", "_h", (F.col("lo") + F.col("_i")).alias("at"), "_s.*"), "strings")
    first = hot.groupBy("x", "y").agg(F.min(order("at")).alias("_first"))
    return hot.join(first, ["x", "y"]).where(order("at") != F.col("_first")).select(
        "_id", "_h", F.col("at").alias("lo"), (F.col("at") + width).alias("hi"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))


def _with(keyed: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Documents with what another table has of them; null ids meet null ids."""
    other = other.withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    return keyed.join(other, (F.col("_h") == F.col("_h2")) & F.col("_id").eqNullSafe(F.col("_id2")), how)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text", **sizes: int) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    Texts are their UTF-8 bytes, null is empty. Every byte covered by a
    string of ``width`` bytes that also starts earlier -- in a document with
    a smaller id, or earlier in the same one -- is removed, as judged on the
    input. Null ids come after all others; documents of one id are ordered
    by their texts' hashes; rows with equal id and text are one document and
    get equal results. Other columns are not read.
    """
    gone = removals(docs, width, gram, id_col, text_col, **sizes).groupBy("_id", "_h").agg(
        F.collect_set(F.struct("lo", "hi")).alias("_gone"))

    @F.pandas_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary,kept_sha256:string>")
    def remove(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, gone):
            data = _bytes(text)
            runs = [] if own is None else merged(*(np.array([min(g[k], len(data)) for g in own], np.int64)
                                                   for k in ("lo", "hi")))
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(data), len(data) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    keyed = _keyed(docs, id_col, text_col)
    joined = _with(keyed, gone, "left")
    return joined.select(F.col("_id").alias(id_col), remove("_text", "_gone").alias("_r")).select(id_col, "_r.*")
