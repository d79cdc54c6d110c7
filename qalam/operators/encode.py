"""Tokenised training tables.

The default tokenizer is a deterministic whitespace tokenizer whose ids are
hashes of the words (``md5`` prefix mod vocabulary), so it runs as native
expressions and can be reproduced in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .formats import render_template

PAD, BOS, EOS = 0, 1, 2
VOCAB = 32000
IGNORE = -100


def word_ids(text: Column, vocab: int = VOCAB) -> Column:
    """Whitespace tokens -> ids in [3, vocab + 3)."""
    return F.transform(T.py_words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocab + 3)
                       .cast("int"))


def mask_prefix(ids: Column, n: Column) -> Column:
    """Labels: the first ``n`` positions set to -100, the rest copied. Built
    from ``array_repeat`` + ``slice`` so ``n`` is evaluated once per row."""
    k = F.least(F.greatest(n, F.lit(0)), F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE), k.cast("int")),
                    F.slice(ids, (k + 1).cast("int"), F.greatest(F.size(ids) - k, F.lit(0)).cast("int")))


def truncate(ids: Column, max_length: int, keep_end: bool = False) -> Column:
    """H4: keep the first (or last) ``max_length`` ids."""
    if keep_end:
        return F.when(F.size(ids) > max_length, F.slice(ids, -max_length, max_length)).otherwise(ids)
    return F.slice(ids, 1, max_length)


def pad_to_multiple(ids: Column, multiple: int = 8, pad: int = PAD) -> Column:
    """H4: right-pad with ``pad`` to a multiple of ``multiple``."""
    need = (F.lit(multiple) - F.size(ids) % multiple) % multiple
    return F.concat(ids, F.array_repeat(F.lit(pad), need.cast("int")))


def sft_encode(df: DataFrame, instruction: str = "instruction", response: str = "response", max_length: int = 512,
               template: str = L.SFT_TEMPLATE, ids_fn=word_ids) -> DataFrame:
    """H1: input_ids of the formatted text (truncated), attention_mask, and
    labels with the instruction part (template with an empty response,
    right-stripped) masked."""
    i, r = T.py_strip(F.col(instruction)), T.py_strip(F.col(response))
    full = render_template(template, instruction=i, response=r)
    prompt = F.regexp_replace(render_template(template, instruction=i, response=F.lit("")), f"[{L.WS}]+$", "")
    ids = truncate(ids_fn(full), max_length)
    n_prompt = F.size(truncate(ids_fn(prompt), max_length))
    return df.select("*", ids.alias("input_ids")) \
        .withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1))) \
        .withColumn("labels", mask_prefix(F.col("input_ids"), F.least(n_prompt, F.size("input_ids"))))


def pair_encode(df: DataFrame, max_length: int = 512, max_prompt_length: int = 256, ids_fn=word_ids) -> DataFrame:
    """H2: prompt, prompt+chosen, prompt+rejected ids; labels mask the
    prompt part (min(prompt_len, len))."""
    p = truncate(ids_fn(F.col("prompt")), max_prompt_length)
    c = truncate(ids_fn(F.concat(F.col("prompt"), F.col("chosen"))), max_length)
    r = truncate(ids_fn(F.concat(F.col("prompt"), F.col("rejected"))), max_length)
    out = df.select("*", p.alias("prompt_input_ids"), c.alias("chosen_input_ids"), r.alias("rejected_input_ids"))
    n = F.size("prompt_input_ids")
    return out.withColumn("chosen_labels", mask_prefix(F.col("chosen_input_ids"), F.least(n, F.size("chosen_input_ids")))) \
        .withColumn("rejected_labels", mask_prefix(F.col("rejected_input_ids"), F.least(n, F.size("rejected_input_ids"))))


def kto_encode(df: DataFrame, label: Column, max_length: int = 512, ids_fn=word_ids) -> DataFrame:
    """H3: prompt and prompt+completion ids, masked labels, binary label."""
    p = truncate(ids_fn(F.col("prompt")), max_length)
    c = truncate(ids_fn(F.concat(F.col("prompt"), F.col("completion"))), max_length)
    out = df.select("*", p.alias("prompt_input_ids"), c.alias("completion_input_ids"), label.alias("binary_label"))
    return out.withColumn("completion_labels", mask_prefix(F.col("completion_input_ids"),
                                                           F.least(F.size("prompt_input_ids"), F.size("completion_input_ids"))))


def completion_only_labels(ids: Column, marker_ids: list[int]) -> Column:
    """H5: mask every position up to the end of the first occurrence of the
    response marker; no marker -> everything masked. Marker matches are
    found with ``zip_with`` over shifted slices (linear per row)."""
    m = len(marker_ids)
    cond = F.transform(ids, lambda x: x == marker_ids[0])
    for k in range(1, m):
        cond = F.zip_with(cond, F.slice(ids, k + 1, F.greatest(F.size(ids) - k, F.lit(0))),
                          lambda c, x, v=marker_ids[k]: c & (x == v))
    first = F.array_position(cond, True)
    end = F.when(first > 0, first + m - 1).otherwise(F.size(ids))
    return mask_prefix(ids, end)


def overflow_windows(ids: Column, max_length: int, stride: int) -> Column:
    """H6: windows of ``max_length`` ids starting every ``stride`` ids."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda s: F.slice(ids, s + 1, max_length))
