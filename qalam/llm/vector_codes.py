"""Vector code compression: product-quantisation codebooks fitted and assigned with Drake and Hamerly's adaptive bounds.

Each vector is cut into parts; each part position has its own codebook. A part
keeps, from one round to the next, its ``b`` closest other entries with ordered
lower bounds on their distances and one outer bound for all the rest. When the
entries move, bounds shrink by the movement; only entries whose bound no longer
exceeds the distance to the part's own entry are compared again, in integers.
``b`` follows the number of bounds that were needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries listed per part at first, and at most.
FIRST_B, MOST_B = 8, 16
#: ``b`` is chosen so that this share of the parts is decided by the listed entries.
DECIDED = 0.99
#: Label sums up to this many rows are broadcast (16 bytes each); beyond, the join is salted.
BROADCAST_LABELS, SALTS = 50_000, 64
_MORE = 1 + 1e-9  # rounding slack of distances in doubles


def limit(size: int, entries: int = ENTRIES) -> int:
    """The largest component with which all sums of squares of a vector, times the entries, stay below 2^62."""
    return 1 << (62 - (size * entries - 1).bit_length()) // 2 - 1


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts [n, w] to entries [k, w] (or to their own entries [n, k, w])."""
    e = entries if entries.ndim == 3 else entries[None]
    total = np.zeros((len(x), e.shape[1]), np.int64)
    for p in range(x.shape[1]):
        total += (x[:, p, None] - e[:, :, p]) ** 2
    return total


def _ordered(low: np.ndarray) -> np.ndarray:
    """Bounds made ascending by lowering; lowered bounds still hold."""
    return np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]


def search(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compare parts with all entries: the nearest (ties: lower index), the next ``b``, their bounds and the outer one, the square.

    Without entries beyond the listed ones the outer bound is infinite.
    """
    k = len(book)
    b = min(b, k - 1)
    key = np.sort(_squares(x, book) * k + np.arange(k), axis=1)
    low = np.full((len(x), b + 1), np.inf)
    m = min(b + 2, k)
    low[:, :m - 1] = np.sqrt(key[:, 1:m] // k)
    return key[:, 0] % k, key[:, 1:b + 1] % k, low, key[:, 0] // k


def refine(x: np.ndarray, code: np.ndarray, near: np.ndarray, low: np.ndarray, old: np.ndarray,
           book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Assign parts to moved entries: ``(code, near, low, squares, needed)``.

    ``needed`` is the number of bounds that did not exceed the distance to the
    part's own entry; one more than listed means that all entries were compared.
    """
    b = near.shape[1]
    moved = np.sqrt(((book - old) ** 2).sum(axis=1)) * _MORE
    low = low.copy()
    low[:, :b] -= moved[near]
    low[:, b] -= moved.max()
    low = _ordered(low)
    code, near = code.copy(), near.copy()
    square = ((x - book[code]) ** 2).sum(axis=1)
    needed = (low <= (np.sqrt(square) * _MORE)[:, None]).sum(axis=1)
    for m in np.unique(needed[(needed > 0) & (needed <= b)]).tolist():
        at = np.flatnonzero(needed == m)
        tried = np.concatenate([code[at, None], near[at, :m]], axis=1)
        key = np.sort(_squares(x[at], book[tried]) * len(book) + tried, axis=1)
        code[at], square[at] = key[:, 0] % len(book), key[:, 0] // len(book)
        near[at, :m], low[at, :m] = key[:, 1:] % len(book), np.sqrt(key[:, 1:] // len(book))
    full = np.flatnonzero(needed > b)
    if len(full):
        code[full], near[full], low[full], square[full] = search(x[full], book, b)
    return code, near, _ordered(low), square, needed


def _next_b(needed: np.ndarray, b: int, k: int) -> int:
    """Bounds to persist: as many as decide :data:`DECIDED` of the parts; more than listed when too many were not decided."""
    q = int(np.quantile(needed, DECIDED, method="higher")) if needed.size else b
    return min(2 * b, MOST_B, k - 1) if q > b else min(b, max(1, q))


def _half(low: np.ndarray) -> np.ndarray:
    """Bounds as 2-byte floats, rounded down: a bound may be too low, never too high."""
    return np.where(low >= 0.5, np.minimum(low * (1 - 2.0 ** -10), 65504), -1.0).astype(np.float16)


def _pack(near: np.ndarray, low: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists cut to ``b`` entries, or filled up to them by repeating the outer bound behind a repeated entry."""
    have = near.shape[2]
    if b > have:
        near = np.concatenate([near, np.repeat(near[:, :, -1:], b - have, axis=2)], axis=2)
        low = np.concatenate([low, np.repeat(low[:, :, -1:], b - have, axis=2)], axis=2)
    return near[:, :, :b], low[:, :, :b + 1]


class _Rows:
    """One Arrow batch of persisted parts as arrays: x [n, parts, w], code [n, parts], near [n, parts, b], low [n, parts, b + 1]."""

    def __init__(self, batch: pa.RecordBatch, parts: int):
        n = batch.num_rows
        self.x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, -1)
        self.code = self.near = self.low = None
        if "_code" in batch.schema.names:
            self.code = np.frombuffer(b"".join(batch.column("_code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
        if "_near" in batch.schema.names:
            near = batch.column("_near").to_pylist()
            low = batch.column("_low").to_pylist()
            most = max(len(v) // parts for v in near)
            self.near = np.zeros((n, parts, most), np.int64)
            self.low = np.zeros((n, parts, most + 1))
            sizes = np.array([len(v) // parts for v in near])
            for b in np.unique(sizes).tolist():  # batches may have been persisted with different b
                at = np.flatnonzero(sizes == b)
                got = np.frombuffer(b"".join(near[i] for i in at), np.uint8).reshape(len(at), parts, b)
                bounds = np.frombuffer(b"".join(low[i] for i in at), np.float16).reshape(len(at), parts, b + 1)
                self.near[at], self.low[at] = _pack(got.astype(np.int64), bounds.astype(float), most)


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, old: np.ndarray | None,
              names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    parts, k = books.shape[:2]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _Rows(batch, parts)
        n = batch.num_rows
        code, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
        lists, lows, needed = [], [], []
        for p in range(parts):
            if old is None:
                code[:, p], near, low, square = search(rows.x[:, p], books[p], FIRST_B)
            else:
                code[:, p], near, low, square, m = refine(
                    rows.x[:, p], rows.code[:, p], rows.near[:, p], rows.low[:, p], old[p], books[p])
                needed.append(m)
            error += square
            lists.append(near)
            lows.append(low)
        near, low = np.stack(lists, axis=1), np.stack(lows, axis=1)
        b = _next_b(np.concatenate(needed), near.shape[2], k) if needed and near.shape[2] else near.shape[2]
        near, low = _pack(near, low, b)
        blobs = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
        made = {"_code": blobs(code.astype(np.uint8)), "_near": blobs(near.astype(np.uint8)), "_low": blobs(_half(low)),
                "_error": pa.array(error, pa.int64())}
        yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=list(names))


def _assign(df: DataFrame, books: np.ndarray, old: np.ndarray | None, *keep: str) -> DataFrame:
    """The rows with codes and, of ``keep``, what the next round needs."""
    made = {"_code": "binary", "_near": "binary", "_low": "binary", "_error": "long"}
    kinds = dict(df.dtypes)
    out = ", ".join(f"{c} {made.get(c) or kinds[c]}" for c in keep)
    return df.mapInArrow(lambda batches: _assigned(batches, books, old, keep), out)


def _updated(df: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries moved to floor(sum / count) of their parts; entries without parts stay.

    Each task sums its parts, Spark adds the tasks' sums; the driver gets one
    row per component of a codebook.
    """
    parts, k, w = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * k, w), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, parts)
            at = (rows.code + np.arange(parts) * k).ravel()
            count += np.bincount(at, minlength=parts * k)
            for p in range(w):
                np.add.at(total[:, p], at, rows.x[:, :, p].ravel())
        for p in range(w):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"slot": used, "pos": np.full(len(used), p), "total": total[used, p],
                                              "n": count[used]})

    found = df.mapInArrow(sums, "slot long, pos long, total long, n long").groupBy("slot", "pos").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    new = books.copy()
    for r in found:
        new[r.slot // k, r.slot % k, r.pos] = int(r.total) // r.n
    return new


def integers(vector: Column, most: Column | int) -> Column:
    """Components as floor(256 x), saturated at plus and minus ``most``."""
    return F.transform(vector, lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(most)),
                                                    F.lit(-most)).cast("int"))


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components, of a length that can be cut into equal parts."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & ~bad


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(rows, codebooks)``: id, label, code (binary, one byte a part) and error of each kept vector.

    Codebooks start as the parts of the 64 vectors with the smallest ids
    (equal ids: by their components; null ids last; fewer vectors: fewer
    entries). Dropped are vectors that are null, empty or hold null or
    non-finite components, and those whose length is not a multiple of 16 or
    differs from that of the vector with the smallest id. Components saturate
    at :func:`limit` (2^24 for 64 components), where squares stay exact.
    Repeated rows stay rows of their own; an empty table gives no rows.
    """
    kept = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"),
                          F.col(vector_col).alias("_v")).where(usable(F.col("_v")))
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(1).collect()
    size = len(first[0]["_v"]) if first else PARTS
    parts = kept.where(F.size("_v") == size).select("_id", "_label", integers(F.col("_v"), limit(size)).alias("_x"))
    start = [r["_x"] for r in parts.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(ENTRIES).collect()]
    if not start:
        return parts.select("_id", "_label", F.lit(b"").alias("_code"), F.lit(0).cast("long").alias("_error")), \
            np.zeros((PARTS, 0, size // PARTS), np.int64)
    books = np.array(start, np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2)
    state, old, now = parts, None, None
    for _ in range(rounds):
        nxt = written(_assign(state, books, old, "_id", "_label", "_x", "_code", "_near", "_low"), "codes")
        if now is not None:
            dropped(now)
        state = now = nxt
        old, books = books, _updated(now.select("_x", "_code"), books)
    return _assign(state, books, old, "_id", "_label", "_code", "_error"), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """``_label_error``: the errors summed over equal labels, null labels together.

    The sums are pre-aggregated; they are broadcast if they are few, else
    joined on the label and a salt, so no hot label meets in one task.
    """
    sums = written(rows.groupBy("_label").agg(F.sum("_error").alias("_label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums.withColumnRenamed("_label", "_l")), F.col("_label").eqNullSafe(F.col("_l"))).drop("_l")
    salted = sums.select(F.col("_label").alias("_l"), "_label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salt = F.pmod(F.xxhash64("_id", "_code"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(
        salted, F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_salt") == F.col("_s"))).drop("_l", "_s", "_salt")


def code_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               label_col: str = "label") -> DataFrame:
    """One row per kept vector: id, code (hex), error, label_error, codebooks_sha256. See :func:`compress`."""
    rows, books = compress(vectors, id_col, vector_col, label_col)
    return with_label_error(written(rows, "codes")).select(
        F.col("_id").alias(id_col), F.lower(F.hex("_code")).alias("code"), F.col("_error").alias("error"),
        F.col("_label_error").alias("label_error"), F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def decode(rows: DataFrame, books: np.ndarray, code_col: str = "_code") -> DataFrame:
    """The rows with ``approx``: the vector that a code stands for, as doubles."""
    flat = F.array(*(F.array(*(F.array(*(F.lit(float(v) / SCALE) for v in e)) for e in book)) for book in books.tolist()))
    part = lambda p: F.element_at(flat[p], F.conv(F.hex(F.substring(code_col, p + 1, 1)), 16, 10).cast("int") + 1)
    return rows.withColumn("approx", F.concat(*(part(p) for p in range(len(books)))))
