"""Filters and validation.

Every check is a boolean or reason Column; filters keep the reason next to
the row so a single pass yields both the kept rows and the rejects table,
and stage counts come from one aggregate over the reason column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dialect import evaluate_once


def length_filter(df: DataFrame, text_col: str, min_len: int = 10, max_len: int = 2048, by: str = "chars") -> DataFrame:
    """Min <= length <= max (characters, or word tokens with by='tokens')."""
    n = F.length(text_col) if by == "chars" else T.word_count(text_col)
    return df.filter(n.between(min_len, max_len))


def word_length_filter(df: DataFrame, text_col: str, min_words: int = 10, max_words: int = 512) -> DataFrame:
    """Inclusive word-count band."""
    return df.filter(T.word_count(text_col).between(min_words, max_words))


def is_quality_text(c, min_length=10, max_length=2000, min_words=3, max_repetition=0.5, min_arabic=0.7,
                    max_special=0.2) -> Column:
    """E3 text test on the stripped text: length, words, word repetition,
    Arabic share of non-space chars, special-char share."""
    t = T.py_strip(c)
    n = F.length(t)
    ok = (F.coalesce(n, F.lit(0)) > 0) & (n >= min_length) & (n <= max_length) & (T.word_count(t) >= min_words)
    ok = ok & (T.word_repetition_ratio(t) <= max_repetition) & (T.arabic_ratio_nonspace(t) >= min_arabic)
    return F.coalesce(ok & (T.special_char_ratio(t) <= max_special), F.lit(False))


def text_quality_filter(df: DataFrame, fields=("prompt", "chosen", "rejected", "response"), negatives: str | None = None,
                        **thresholds) -> DataFrame:
    """``filter_reason`` = 'Low quality <field>' for the first failing
    field present (null when all pass); bad negatives are removed."""
    present = [f for f in fields if f in df.columns]
    reason = None
    for f in reversed(present):
        bad = F.col(f).isNotNull() & ~is_quality_text(F.col(f), **thresholds)
        reason = F.when(bad, F.lit(f"Low quality {f}")).otherwise(reason if reason is not None else F.lit(None).cast("string"))
    out = df.withColumn("filter_reason", reason if reason is not None else F.lit(None).cast("string"))
    if negatives and negatives in df.columns:
        out = out.withColumn(negatives, F.filter(negatives, lambda x: is_quality_text(x, **thresholds)))
    return out


def quality_check(c, min_arabic: float = 0.7, max_repetition: float = 0.3) -> Column:
    """Score 1 - .3 (low Arabic) - .4 (trigram repetition) - .2 (< 5
    words) or - .1 (> 1000 words), floored at 0; issue codes; passed > .5."""
    parts = F.struct(T.arabic_ratio_block_alpha(c).alias("ar"), T.once(T.py_words(c), lambda w: F.struct(
        F.size(w).alias("n"), T.trigram_repetition_of(w).alias("rep"))).alias("w"))
    return T.once(parts, lambda p: _quality_struct(p["ar"], p["w"]["rep"], p["w"]["n"], min_arabic, max_repetition))


def _quality_struct(ar: Column, rep: Column, n: Column, min_arabic: float, max_repetition: float) -> Column:
    score = (F.lit(1.0) - F.when(ar < min_arabic, 0.3).otherwise(0.0) - F.when(rep > max_repetition, 0.4).otherwise(0.0)
             - F.when(n < 5, 0.2).when(n > 1000, 0.1).otherwise(0.0))
    issues = F.array_compact(F.array(F.when(ar < min_arabic, F.lit("low_arabic")),
                                     F.when(rep > max_repetition, F.lit("high_repetition")),
                                     F.when(n < 5, F.lit("too_short")).when(n > 1000, F.lit("very_long"))))
    return F.struct(F.greatest(score, F.lit(0.0)).alias("quality_score"), ar.alias("arabic_ratio"),
                    rep.alias("repetition_ratio"), n.alias("word_count"), issues.alias("issues"), (score > 0.5).alias("passed"))


def filter_by_quality(df: DataFrame, text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """Add quality_score / quality_issues and keep score >= min."""
    # computed once: a filter on a plain column would compute it again, the text itself included
    return evaluate_once(df, {"__q": quality_check(F.col(text_col))}).select("*", F.col("__q.quality_score").alias("quality_score"),
                                          F.col("__q.issues").alias("quality_issues")).drop("__q") \
        .filter(F.col("quality_score") >= min_score)


def validate_rules(df: DataFrame, rules: dict) -> DataFrame:
    """E5: per field rules {required, type, min_length, max_length, pattern,
    check with message} -> ``errors`` array and ``is_valid``. Type rules
    resolve on the schema; ``check`` is a function from column to predicate."""
    errs = []
    for field, r in rules.items():
        if field not in df.columns:
            if r.get("required"):
                errs.append(F.lit(f"{field}: missing required field"))
            continue
        c = F.col(field)
        if r.get("required"):
            errs.append(F.when(c.isNull() | (c.cast("string") == ""), F.lit(f"{field}: required")))
        if "type" in r and df.schema[field].dataType.typeName() != r["type"]:
            errs.append(F.lit(f"{field}: expected {r['type']}"))
        if "min_length" in r:
            errs.append(F.when(F.length(c) < r["min_length"], F.lit(f"{field}: shorter than {r['min_length']}")))
        if "max_length" in r:
            errs.append(F.when(F.length(c) > r["max_length"], F.lit(f"{field}: longer than {r['max_length']}")))
        if "pattern" in r:
            errs.append(F.when(~c.rlike(r["pattern"]), F.lit(f"{field}: pattern mismatch")))
        if "check" in r:  # U3: the caller's predicate, column to column; what is not true fails
            errs.append(F.when(~F.coalesce(r["check"](c), F.lit(False)), F.lit(f"{field}: {r.get('message', 'check failed')}")))
    arr = F.array_compact(F.array(*errs)) if errs else F.array().cast("array<string>")
    return df.withColumn("errors", arr).withColumn("is_valid", F.size("errors") == 0)


def validation_report(validated: DataFrame, top: int = 10) -> DataFrame:
    """Total / valid / invalid rows plus the ``top`` most frequent errors
    (rows carrying each error). Long table (section, key, value)."""
    tot = validated.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("valid"),
                        F.count_if(~F.col("is_valid")).alias("invalid"))
    summary = tot.unpivot([], ["total", "valid", "invalid"], "key", "value").withColumn("section", F.lit("summary"))
    errs = validated.select(F.explode(F.array_distinct("errors")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("value"))
    top_errs = errs.orderBy(F.col("value").desc(), "key").limit(top).withColumn("section", F.lit("top_errors"))
    return summary.select("section", "key", "value").unionByName(top_errs.select("section", "key", "value"))


def dataset_gate(df: DataFrame, text_col: str = "text", required: tuple[str, ...] = ("text",), min_size: int = 100,
                 max_size: int = 1_000_000, min_avg_words: float = 10.0, max_avg_words: float = 1000.0,
                 min_arabic_ratio: float = 0.5) -> DataFrame:
    """One row of statistics over all texts, issues and warnings.

    Too few rows and missing columns are issues and fail the gate; too many
    rows, a mean word count outside the bounds and a low mean share of Arabic
    characters among the letters are warnings. Null texts count as empty;
    without rows or without the text column the text statistics are null and
    warn of nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit("")) if text_col in df.columns else F.lit(None).cast("string")
    a = df.select(T.word_count(text).alias("n"), T.arabic_ratio_block_alpha(text).alias("r"),
                  text.isNotNull().alias("has")).agg(
        F.count(F.lit(1)).alias("size"), F.avg(F.when(F.col("has"), F.col("n"))).alias("avg_words"),
        F.min(F.when(F.col("has"), F.col("n"))).cast("long").alias("min_words"),
        F.max(F.when(F.col("has"), F.col("n"))).cast("long").alias("max_words"),
        F.avg(F.when(F.col("has"), F.col("r"))).alias("avg_arabic_ratio"))
    missing = [c for c in required if c not in df.columns]
    issues = F.array_compact(F.array(F.when(F.col("size") < min_size, F.lit("too_small")),
                                     *[F.lit(f"missing_column:{c}") for c in missing]))
    warnings = F.array_compact(F.array(F.when(F.col("size") > max_size, F.lit("very_large")),
                                       F.when(F.col("avg_words") < min_avg_words, F.lit("short_texts")),
                                       F.when(F.col("avg_words") > max_avg_words, F.lit("long_texts")),
                                       F.when(F.col("avg_arabic_ratio") < min_arabic_ratio, F.lit("low_arabic_content"))))
    return a.select("*", issues.alias("issues"), warnings.alias("warnings"), (F.size(issues) == 0).alias("passed"))


def _blank(c: str) -> Column:
    return F.coalesce(T.py_strip(F.col(c).cast("string")), F.lit("")) == ""


def method_checks(df: DataFrame, method: str) -> DataFrame:
    """Per-rule violation counts over all rows (the reference looks at the
    first row only), and whether the table passes.

    Fields that are null cannot be extracted; sft rows fail when instruction
    and response are both blank, kto and pair rows when any text is blank.
    """
    cols = {"sft": ["instruction", "response"], "kto": ["prompt", "completion", "label"]}.get(method, ["prompt", "chosen", "rejected"])
    texts = [c for c in cols if c != "label"]
    blanks = [_blank(c) for c in texts]
    empty = blanks[0] & blanks[1] if method == "sft" else blanks[0] | blanks[1] | (blanks[2] if len(blanks) > 2 else F.lit(False))
    missing = F.col(cols[0]).isNull()
    for c in cols[1:]:
        missing = missing | F.col(c).isNull()
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("missing_fields"), F.count_if(~missing & empty).alias("empty_texts"),
            *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"empty_{c}") for c in cols]]
    if method not in ("sft", "kto"):
        aggs.append(F.count_if(F.col("chosen") == F.col("rejected")).alias("chosen_equals_rejected"))
    return df.agg(*aggs).withColumn("passed", (F.col("missing_fields") == 0) & (F.col("empty_texts") == 0))


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a null in any of ``cols`` are dropped."""
    return df.dropna(subset=cols)


def sft_valid(instruction="instruction", response="response", min_len=1, max_len=4096) -> Column:
    """Both non-blank and within length bounds."""
    i, r = T.py_strip(instruction), T.py_strip(response)
    return (F.length(i).between(min_len, max_len) & F.length(r).between(min_len, max_len))


def _within(c: str, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def preference_valid(min_len: int = 10, max_len: int = 4096, min_diversity: float = 0.1, require_arabic: bool = False,
                     min_prompt: int = 1, max_prompt: int = 1024) -> Column:
    """Lengths of prompt and responses, chosen/rejected diversity (sim < 1 - min), language of all three."""
    ok = _within("prompt", min_prompt, max_prompt) & _within("chosen", min_len, max_len) & _within("rejected", min_len, max_len)
    ok = ok & (T.sim("chosen", "rejected") < 1.0 - min_diversity)
    if require_arabic:
        ok = ok & T.has_arabic("prompt") & T.has_arabic("chosen") & T.has_arabic("rejected")
    return ok


def dpo_filter(df: DataFrame, min_len: int = 10, max_len: int = 4096, min_quality_diff: float = 0.1,
               max_similarity: float = 0.9, min_strength: float = 0.5, max_ratio: float = 3.0, min_prompt: int = 1,
               max_prompt: int = 1024) -> DataFrame:
    """Stripped prompt and response lengths, quality difference,
    similarity cap, preference strength (C28) and length ratio; keeps the
    first failing reason."""
    n = {c: F.length(T.py_strip(c)) for c in ("prompt", "chosen", "rejected")}
    ratio = F.greatest(F.length("chosen"), F.length("rejected")) / F.greatest(F.least(F.length("chosen"), F.length("rejected")), F.lit(1))
    reason = (F.when(~n["prompt"].between(min_prompt, max_prompt), F.lit("prompt_length"))
              .when(~(n["chosen"].between(min_len, max_len) & n["rejected"].between(min_len, max_len)), F.lit("length"))
              .when(T.quality("chosen") - T.quality("rejected") < min_quality_diff, F.lit("quality_diff"))
              .when(T.sim("chosen", "rejected") > max_similarity, F.lit("similarity"))
              .when(T.dpo_strength("chosen", "rejected") < min_strength, F.lit("strength"))
              .when(ratio > max_ratio, F.lit("length_ratio")))
    return df.withColumn("filter_reason", reason)


def ipo_filter(df: DataFrame, max_ratio: float = 3.0, min_diff: int = 20, max_bias: float = 0.5,
               min_normalized_quality: float = 0.0) -> DataFrame:
    """Longer to shorter length ratio, least length difference,
    length-bias score, and the least difference of the length-normalised
    qualities (chosen less rejected)."""
    lc, lr = F.length("chosen"), F.length("rejected")
    normal = lambda c: T.length_normalized_quality(T.quality(c), F.length(c))
    reason = (F.when(F.greatest(lc, lr) / F.greatest(F.least(lc, lr), F.lit(1)) > max_ratio, F.lit("length_ratio"))
              .when(F.abs(lc - lr) < min_diff, F.lit("length_difference"))
              .when(T.length_bias("chosen", "rejected") > max_bias, F.lit("length_bias"))
              .when(normal("chosen") - normal("rejected") < min_normalized_quality, F.lit("normalized_quality")))
    return df.withColumn("filter_reason", reason)


def kto_filter(df: DataFrame, min_len: int = 10, max_len: int = 4096, min_quality: float = 0.2,
               utility_range=(-2.25, 1.0), min_prompt: int = 1, max_prompt: int = 1024) -> DataFrame:
    """Label present, prompt and completion lengths (the least without
    surrounding white space, the most with it), quality floor, utility range."""
    q = T.quality("completion")
    util = T.kto_utility(q, F.col("label") == 1)
    bounds = lambda c, low, high: (F.length(T.py_strip(c)) >= low) & (F.length(c) <= high)
    reason = (F.when(F.col("label").isNull(), F.lit("label"))
              .when(~F.coalesce(bounds("prompt", min_prompt, max_prompt), F.lit(False)), F.lit("prompt_length"))
              .when(~bounds("completion", min_len, max_len), F.lit("length"))
              .when(q < min_quality, F.lit("quality"))
              .when(~util.between(*utility_range), F.lit("utility")))
    return df.withColumn("filter_reason", reason)


def cpo_valid(negs: str = "negatives", min_negs: int = 2, max_negs: int = 8, min_len: int = 1, min_prompt: int = 1,
              max_similarity: float = 0.9) -> Column:
    """Prompt, chosen and every negative long enough (stripped), between
    min and max negatives, and contrast: no negative is nearly the chosen
    text (similarity above ``max_similarity``)."""
    long_enough = (F.length(T.py_strip("prompt")) >= min_prompt) & (F.length(T.py_strip("chosen")) >= min_len)
    return long_enough & F.size(negs).between(min_negs, max_negs) & F.forall(negs, lambda x: F.length(T.py_strip(x)) >= min_len) \
        & F.forall(negs, lambda x: T.sim(F.col("chosen"), x) <= max_similarity)


def length_ratio_filter(df: DataFrame, max_ratio: float = 2.0) -> DataFrame:
    """Drop pairs whose longer/shorter length ratio exceeds ``max_ratio``."""
    a, b = F.length("chosen"), F.length("rejected")
    return df.filter(F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1)) <= max_ratio)


def stage_counts(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Ordered stages, each a keep-predicate; a row is attributed to the
    first stage that rejects it. One aggregate gives the per-stage
    processed / filtered counts and rates (``df.observe`` would give the
    same numbers alongside a write)."""
    reason = None
    for name, keep in reversed(stages):
        reason = F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)).otherwise(reason if reason is not None else F.lit(None))
    tagged = df.withColumn("__stage", reason)
    counts = tagged.groupBy("__stage").agg(F.count(F.lit(1)).alias("c"))
    spark = df.sparkSession
    order = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(stages)], "idx int, stage string")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    j = order.join(counts.withColumnRenamed("__stage", "stage"), "stage", "left").crossJoin(total).fillna(0, ["c"])
    from pyspark.sql import Window as W
    removed_before = F.coalesce(F.sum("c").over(W.orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    processed = F.col("total") - removed_before
    return j.select("idx", "stage", processed.alias("processed"), F.col("c").alias("filtered"),
                    F.when(processed > 0, F.col("c") / processed).otherwise(0.0).alias("filter_rate"))


def sample_format_issues(df: DataFrame, key: str, format_type: str) -> DataFrame:
    """One row per (key, issue). Instruction rows: blank instruction or
    output; text rows: blank, or under 10 characters."""
    def blank(c):
        return F.coalesce(T.py_strip(F.col(c)), F.lit("")) == "" if c in df.columns else F.lit(True)

    if format_type == "instruction":
        issues = [F.when(blank(c), F.lit(f"Empty or missing {c}")) for c in ("instruction", "output")]
    elif format_type == "text":
        issues = [F.when(blank("text"), F.lit("Empty or missing text"))]
        if "text" in df.columns:
            issues = [issues[0].when(F.length("text") < 10, F.lit("Text too short"))]
    else:
        raise ValueError(f"unknown format: {format_type}")
    return df.select(key, F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def fail_fast_preference(df: DataFrame) -> None:
    """Raise when a required column is missing or any chosen/rejected is
    empty (only the first offending row is fetched)."""
    for c in ("prompt", "chosen", "rejected"):
        if c not in df.columns:
            raise ValueError(f"missing column: {c}")
    bad = df.filter((F.coalesce(F.col("chosen"), F.lit("")) == "") | (F.coalesce(F.col("rejected"), F.lit("")) == "")).limit(1).collect()
    if bad:
        raise ValueError("empty chosen or rejected response")


def split_checks(df: DataFrame, required: list[str], expected: tuple[str, ...] = ("train", "validation", "test"),
                 split_col: str = "split") -> DataFrame:
    """One row per expected or present split: its rows, whether it has
    any, whether there is a train split, and the required columns that are
    missing (decided on the schema)."""
    missing = [c for c in required if c not in df.columns]
    per = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
    names = df.sparkSession.createDataFrame([(x,) for x in expected], f"{split_col} string")
    every = per.join(names, split_col, "full_outer").withColumn("rows", F.coalesce("rows", F.lit(0)))
    train = F.max(((F.col(split_col) == "train") & (F.col("rows") > 0)).cast("int")).over(Window.partitionBy())
    return every.select(split_col, "rows", (F.col("rows") > 0).alias("non_empty"), (train == 1).alias("has_train"),
                        F.lit(",".join(missing)).alias("missing_columns"))
