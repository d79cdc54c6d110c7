"""Language identification: a byte convolutional network over fixed-length windows, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quota

#: At most so many documents are learned from: of each language, then in all, those with the smallest hash of their id.
MAX_FIT_PER_LANG, MAX_FIT_ROWS = 600, 20_000
#: At most so many windows of a document are learned from, spread evenly over its whole text.
MAX_FIT_WINDOWS = 6
WINDOW, WIDTHS, FILTERS, SIZE = 256, (2, 3, 4, 5), 12, 6
STEPS, BATCH, RATE, SHORTENED = 700, 64, 0.004, 0.4
UNKNOWN = "und"
_REACH = WINDOW + max(WIDTHS) - 1
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def windows(data: bytes) -> np.ndarray:
    """All windows of a text as rows of bytes, the last filled up with zeros.

    A row reaches into the next window by the widest filter less one, so
    every filter meets every position of the whole text.
    """
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros((n + 1) * WINDOW, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, _REACH)[:n * WINDOW:WINDOW]


@dataclass
class Net:
    """Byte vectors, filters of all widths in one matrix (zero below a filter's width), pooling and a softmax layer."""
    langs: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, rows: np.ndarray) -> np.ndarray:
        """[n, WINDOW, widest * SIZE]: the byte vectors that the filters see at each position."""
        flat = np.take(self.vectors, rows, axis=0).reshape(len(rows), -1)
        seen = np.lib.stride_tricks.sliding_window_view(flat, max(WIDTHS) * SIZE, axis=1)[:, ::SIZE]
        return np.ascontiguousarray(seen)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        seen = (self.patches(rows).reshape(-1, max(WIDTHS) * SIZE) @ self.filters).reshape(len(rows), WINDOW, -1)
        width = WINDOW
        while width > 1:  # halves against each other, in place: long vector operations
            width //= 2
            np.maximum(seen[:, :width], seen[:, width:2 * width], out=seen[:, :width])
        return np.maximum(seen[:, 0] + self.bias, 0)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """[windows, languages], a block of windows at a time."""
        found = [_softmax(self.pooled(rows[i:i + BATCH]) @ self.out + self.out_bias) for i in range(0, len(rows), BATCH)]
        return np.concatenate(found) if found else np.zeros((0, len(self.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each whole text: the windows' probabilities, weighted by their bytes.

        Null texts and texts without a letter are :data:`UNKNOWN` with score 0, like all without a learned language.
        """
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        blocks, owners, sizes = [], [], []
        total = np.zeros((len(texts), len(self.langs)))
        pending = 0

        def add() -> None:
            p = self.probabilities(np.concatenate(blocks)) * np.concatenate(sizes)[:, None]
            np.add.at(total, np.concatenate(owners), p)

        for i in known:
            data = texts[i].encode("utf-8", "surrogatepass")
            rows = windows(data)
            for k in range(0, len(rows), 4096):  # a very long text is not one block
                part = rows[k:k + 4096]
                blocks.append(part)
                owners.append(np.full(len(part), i))
                sizes.append(np.minimum(WINDOW, len(data) - WINDOW * np.arange(k, k + len(part))))
                pending += len(part)
                if pending >= 4096:
                    add()
                    blocks, owners, sizes, pending = [], [], [], 0
        if pending:
            add()
        for i in known:
            share = total[i] / total[i].sum()
            k = int(share.argmax())
            langs[i], scores[i] = self.langs[k], float(min(1.0, share[k]))
        return langs, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mask() -> np.ndarray:
    """Which weights of the filter matrix are in use: a filter of width w sees its first w bytes."""
    reach = np.repeat(WIDTHS, FILTERS)
    return (np.repeat(np.arange(max(WIDTHS)), SIZE)[:, None] < reach[None, :]).astype(np.float32)


def gradients(net: Net, rows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of windows with language numbers, and its gradient by every parameter."""
    n, width = len(rows), max(WIDTHS) * SIZE
    seen = net.patches(rows)
    maps = (seen.reshape(-1, width) @ net.filters).reshape(n, WINDOW, -1)
    top = maps.argmax(axis=1)  # pooling passes a gradient to the position that won
    raw = np.take_along_axis(maps, top[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(raw, 0)
    p = _softmax(hidden @ net.out + net.out_bias)
    loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
    d = p.copy()
    d[np.arange(n), y] -= 1
    d /= n
    back = (d @ net.out.T) * (raw > 0)
    won = seen[np.arange(n)[:, None], top]  # [n, filters, width]
    d_filters = np.einsum("nfk,nf->kf", won, back, optimize=True) * _mask()
    spread = (back[:, :, None] * (net.filters * _mask()).T[None]).reshape(-1, SIZE)
    bytes_seen = rows[np.arange(n)[:, None, None], top[:, :, None] + np.arange(max(WIDTHS))].ravel()
    d_vectors = np.stack([np.bincount(bytes_seen, spread[:, k], 256) for k in range(SIZE)], axis=1)
    return loss, {"vectors": d_vectors, "filters": d_filters, "bias": back.sum(0), "out": hidden.T @ d, "out_bias": d.sum(0)}


def new_net(langs: list[str], seed: int = 0) -> Net:
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Net(langs, draw(256, SIZE, scale=0.5), draw(max(WIDTHS) * SIZE, n, scale=0.3) * _mask(),
               np.zeros(n, np.float32), draw(n, len(langs), scale=0.1), np.zeros(len(langs), np.float32))


def fit(texts: list[list[bytes]], langs: list[str], steps: int = STEPS) -> Net:
    """A net trained with Adam on documents given as lists of windows (at most WINDOW bytes and the reach beyond).

    Each step draws documents, languages evenly, then a window of each; a
    share of them is cut short, as short texts come too. The seed is fixed
    and the documents' order is the caller's, so a fit can be repeated.
    """
    names = sorted(set(langs))
    net = new_net(names)
    if len(names) < 2:
        return net  # with one language its share is 1
    rng = np.random.default_rng(1)
    of = [[i for i, lang in enumerate(langs) if lang == name] for name in names]
    keys = ["vectors", "filters", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in keys}
    second = {k: np.zeros_like(getattr(net, k)) for k in keys}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), BATCH)
        rows = np.zeros((BATCH, _REACH), np.uint8)
        for j, lang in enumerate(y):
            doc = texts[of[lang][rng.integers(len(of[lang]))]]
            data = doc[rng.integers(len(doc))]
            if rng.random() < SHORTENED and len(data) > 12:
                at = int(rng.integers(0, len(data) - 12))
                data = data[at:at + int(rng.integers(12, 64))]
            rows[j, :len(data)] = np.frombuffer(data, np.uint8)
        _, grads = gradients(net, rows, y)
        rate = RATE * (1 - step / (steps + 1))
        for k in keys:
            first[k] += 0.1 * (grads[k] - first[k])
            second[k] += 0.001 * (grads[k] ** 2 - second[k])
            move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, mod 3, is 1 (null ids: held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _fit_windows(text: Column, most: int) -> Column:
    """At most ``most`` windows of each text, spread evenly over all of it."""
    def run(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            n = max(1, -(-len(data) // WINDOW))
            at = sorted({k * n // most for k in range(most)}) if n > most else range(n)
            found.append([data[i * WINDOW:i * WINDOW + _REACH] for i in at])
        return pd.Series(found, dtype=object)

    return F.pandas_udf(run, "array<binary>")(text)


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  per_lang: int = MAX_FIT_PER_LANG, most: int = MAX_FIT_ROWS, steps: int = STEPS) -> Net:
    """A net fitted on documents with a language and a letter that are not held out.

    At most ``per_lang`` of each language and ``most`` in all, languages in
    turn, those with the smallest hash of their id, whatever the table's
    size and order. Of several texts of one id and language one counts.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(
        F.col("_text").rlike(r"\p{L}"))
    quotas = named.groupBy("_lang").agg(F.lit(per_lang).alias("quota"))
    few = quota.smallest(named.select("_lang", "_id"), ["_lang"], quotas, "_id").distinct()  # a filter: no language meets in a task
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(quota.u32(42, F.col("_id")), "_id"))
    drawn = few.withColumn("_place", place).orderBy("_place", "_lang").limit(most).select("_id", "_lang")
    # at most `most` (id, language) pairs are broadcast
    sample = named.join(F.broadcast(drawn), ["_id", "_lang"]).groupBy("_id", "_lang").agg(
        F.min(_fit_windows(F.col("_text"), MAX_FIT_WINDOWS)).alias("_x")).collect()
    sample.sort(key=lambda r: (str(r["_lang"]), str(r["_id"])))
    return fit([[bytes(w) for w in r["_x"]] for r in sample], [r["_lang"] for r in sample], steps)


def identify(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, held_out, lang_pred, score; see :meth:`Net.predict`."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = net.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    found = F.pandas_udf(run, "lang_pred string, score double")(F.col(text_col))
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), found.alias("_found")).select(
        id_col, "held_out", "_found.lang_pred", "_found.score")


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """Languages of whole texts by a net fitted on the table's own documents that are not held out.

    Only texts enter a prediction. Repeated rows are judged alike; without
    any labelled document, and for an empty table, nothing is learned.
    """
    return identify(docs, fit_documents(docs, id_col, text_col, lang_col), id_col, text_col)
