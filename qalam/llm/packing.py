"""Best-fit decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 2048
#: Pieces packed together in one task; the number of groups follows the input.
GROUP_ROWS = 32_768


def byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + i)] = b
    return names


_encoders: dict[str, object] = {}


def encoder(path: str):
    """A byte-pair encoder of the vocabulary file at ``path``, kept for the life of the worker.

    Reads the tokenizer file and gives its ids through tiktoken, which takes
    a sixth of the time. Tokens' ids are their merge ranks in such a file,
    its added tokens have ids of their own; tests hold the ids against the
    file's own library.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in or look at their neighbours are not supported")
        ranks = {bytes(names[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        _encoders[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens=added)
    return _encoders[path]


def encode(path: str, text: str, added: bool = False) -> np.ndarray:
    """The token ids of a text; the file's added tokens count as such, or else as ordinary text.

    With ``added`` the ids are those of the file's own library at its
    defaults, without it those under ``encode_special_tokens``.
    """
    special = {"allowed_special": "all" if added else set(), "disallowed_special": ()}
    try:
        return encoder(path).encode_to_numpy(text, **special)
    except UnicodeEncodeError:  # lone surrogates, which no UTF-8 text holds
        return encoder(path).encode_to_numpy(text.encode("utf-8", "replace").decode(), **special)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity``, the rest of the division first."""
    first = length % capacity or capacity
    edges = [0, *range(min(first, length), length + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32, and the ids themselves on demand.

    A document is its token ids, added tokens' strings as their own ids, and ``end_id``; null and empty texts are
    ``end_id`` alone. Only documents longer than ``capacity`` are cut.
    Repeated rows and null ids are documents of their own.
    """
    @F.pandas_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<int>" * with_ids + ">>")
    def pieces(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            ids = np.append(encode(path, text or "", added=True), end_id).astype("<u4")
            out.append([{"start": start, "length": n, "ids_crc32": zlib.crc32(ids[start:start + n].tobytes())}
                        | ({"ids": ids[start:start + n].astype(np.int32)} if with_ids else {})
                        for start, n in cut(len(ids), capacity)])
        return pd.Series(out, dtype=object)

    return docs.select(F.col(id_col).alias("_id"), F.posexplode(pieces(F.col(text_col))).alias("piece", "_p")).select(
        F.col("_id").alias(id_col), "piece", "_p.*")


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, step: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += step
            i >>= 1

    def push(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out a bin with the least room of at least ``length``: (room, bin)."""
        i = length + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; the longest first, each into the tightest open bin that holds it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = OpenBins(capacity), 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        room, b = tree.tightest(size) or (capacity, n)
        n += b == n
        bins[k], offsets[k] = b, capacity - room
        if room > size:
            tree.push(room - size, b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset; every other column stays.

    A piece of full length is a sequence of its own. The others are dealt
    evenly into groups of about ``group_rows`` pieces, whose number follows
    the input, and each group is packed best-fit decreasing; a group leaves
    a few part-filled sequences, so the loss does not depend on the input's
    size. Lengths must lie in 1..capacity.
    """
    length = F.col("_piece.length")
    rows = written(pieces.select(F.struct("*").alias("_piece"), F.monotonically_increasing_id().alias("_at")), "pieces")
    short = rows.where(length < capacity).select("_at", length.alias("length"))
    groups = max(1, -(-short.count() // group_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"_at": pdf["_at"], "sequence_id": (int(key[0]) << 32 | bins) * 2 + 1, "offset": offsets})

    packed = short.withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups))).groupBy("_group").applyInPandas(
        run, "_at long, sequence_id long, offset long")
    full = rows.where(length >= capacity).select("_piece.*", (F.col("_at") * 2).alias("sequence_id"),
                                                 F.lit(0).cast("long").alias("offset"))
    return full.unionAll(rows.where(length < capacity).join(packed, "_at").select("_piece.*", "sequence_id", "offset"))
