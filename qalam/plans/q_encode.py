"""Tokenised training-table queries (H*): id arrays are compared as
(size, md5 of the comma-joined ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import encode as H
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register


def ids_sql(x: str, vocab: int = H.VOCAB) -> str:
    return f"list_transform({S.words(x)}, lambda w: CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {vocab} + 3 AS INTEGER))"


def trunc_sql(a: str, n: int) -> str:
    return f"{a}[1:{n}]"


def mask_sql(a: str, n: str) -> str:
    return f"list_transform({a}, lambda x, i: CASE WHEN i - 1 < {n} THEN -100 ELSE x END)"


def dig(a: str) -> str:
    return f"md5(array_to_string({a}, ','))"


def sdig(c):
    return F.md5(F.array_join(c, ","))


def _render_sql(template: str, **fields) -> str:
    import string
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(S.q(literal))
        if name is not None:
            parts.append(fields[name])
    return "(" + " || ".join(parts) + ")"


def _h1_sql():
    i, r = S.strip("instruction"), S.strip("response")
    full = _render_sql(L.SFT_TEMPLATE, instruction=i, response=r)
    prompt = S.rr(_render_sql(L.SFT_TEMPLATE, instruction=i, response="''"), f"[{L.WS}]+$")
    body = (f"SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n_ids, {dig('ids')} AS ids_md5, {dig(mask_sql('ids', 'least(np, len(ids))'))} "
            f"AS labels_md5 FROM (SELECT conv_id, turn, {trunc_sql(ids_sql(full), 512)} AS ids, len({trunc_sql(ids_sql(prompt), 512)}) AS np "
            "FROM sft) x")
    return S.with_views(body, "sft")


@register("h1_sft_encode", _h1_sql)
def h1_sft_encode(spark, sf):
    e = H.sft_encode(TB.sft(spark, sf))
    return e.select("conv_id", "turn", F.size("input_ids").cast("long").alias("n_ids"), sdig("input_ids").alias("ids_md5"),
                    sdig("labels").alias("labels_md5"))


def _h2_sql():
    body = (f"SELECT id, {dig('p')} AS prompt_md5, {dig('c')} AS chosen_md5, {dig('r')} AS rejected_md5, "
            f"{dig(mask_sql('c', 'least(len(p), len(c))'))} AS chosen_labels_md5, {dig(mask_sql('r', 'least(len(p), len(r))'))} "
            f"AS rejected_labels_md5 FROM (SELECT id, {trunc_sql(ids_sql('prompt'), 256)} AS p, "
            f"{trunc_sql(ids_sql('prompt || chosen'), 512)} AS c, {trunc_sql(ids_sql('prompt || rejected'), 512)} AS r FROM pairs) x")
    return S.with_views(body, "pairs")


@register("h2_pairwise_encode", _h2_sql)
def h2_pairwise_encode(spark, sf):
    e = H.pair_encode(TB.pairs(spark, sf))
    return e.select("id", sdig("prompt_input_ids").alias("prompt_md5"), sdig("chosen_input_ids").alias("chosen_md5"),
                    sdig("rejected_input_ids").alias("rejected_md5"), sdig("chosen_labels").alias("chosen_labels_md5"),
                    sdig("rejected_labels").alias("rejected_labels_md5"))


@register("h3_kto_encode",
          lambda: S.with_views(f"SELECT id, {dig('c')} AS completion_md5, {dig(mask_sql('c', 'least(len(p), len(c))'))} AS labels_md5, "
                               f"CASE WHEN label = 1 THEN 1 ELSE 0 END AS binary_label FROM (SELECT id, label, "
                               f"{trunc_sql(ids_sql('prompt'), 512)} AS p, {trunc_sql(ids_sql('prompt || completion'), 512)} AS c FROM kto) x",
                               "kto"))
def h3_kto_encode(spark, sf):
    from ..operators.formats import binary_label
    e = H.kto_encode(TB.kto(spark, sf), binary_label(F.col("label"), "int"))
    return e.select("id", sdig("completion_input_ids").alias("completion_md5"), sdig("completion_labels").alias("labels_md5"),
                    "binary_label")


@register("h4_truncate_pad",
          lambda: f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_padded, {dig('p')} AS padded_md5, {dig('e')} AS keep_end_md5 FROM "
                  f"(SELECT doc_id, list_concat(t, list_transform(range(CAST((8 - len(t) % 8) % 8 AS BIGINT)), lambda z: 0)) AS p, "
                  f"CASE WHEN len(a) > 100 THEN a[-100:] ELSE a END AS e FROM (SELECT doc_id, {ids_sql('text')} AS a, "
                  f"{trunc_sql(ids_sql('text'), 100)} AS t FROM documents) y) x")
def h4_truncate_pad(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", H.word_ids(F.col("text")).alias("a"))
    t = H.truncate(F.col("a"), 100)
    return d.select("doc_id", F.size(H.pad_to_multiple(t)).cast("long").alias("n_padded"), sdig(H.pad_to_multiple(t)).alias("padded_md5"),
                    sdig(H.truncate(F.col("a"), 100, keep_end=True)).alias("keep_end_md5"))


MARKER = "###"


def _h5_sql():
    mid = f"CAST(('0x' || substr(md5({S.q(MARKER)}), 1, 8))::BIGINT % {H.VOCAB} + 3 AS INTEGER)"
    end = f"coalesce(list_position(ids, {mid}), len(ids))"
    return S.with_views(f"SELECT conv_id, turn, {dig(mask_sql('ids', end))} AS labels_md5 FROM (SELECT conv_id, turn, "
                        f"{ids_sql('instruction || ' + S.q(' ' + MARKER + ' ') + ' || response')} AS ids FROM sft) x", "sft")


@register("h5_completion_only_labels", _h5_sql)
def h5_completion_only_labels(spark, sf):
    s = TB.sft(spark, sf)
    ids = H.word_ids(F.concat(F.col("instruction"), F.lit(f" {MARKER} "), F.col("response")))
    marker = spark.range(1).select(H.word_ids(F.lit(MARKER)).alias("m")).first()["m"]
    return s.select("conv_id", "turn", sdig(H.completion_only_labels(ids, marker)).alias("labels_md5"))


@register("h6_overflow_windows",
          lambda: f"SELECT doc_id, CAST(s AS BIGINT) AS start, {dig('a[s + 1:s + 256]')} AS window_md5 FROM (SELECT doc_id, a, "
                  f"unnest(range(0, greatest(len(a) - 1, 0) + 1, 128)) AS s FROM (SELECT doc_id, {ids_sql('text')} AS a FROM documents) y) x")
def h6_overflow_windows(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", H.word_ids(F.col("text")).alias("a"))
    w = d.select("doc_id", F.posexplode(H.overflow_windows(F.col("a"), 256, 128)).alias("k", "win"))
    return w.select("doc_id", (F.col("k") * 128).cast("long").alias("start"), sdig(F.col("win")).alias("window_md5"))
