"""Aggregations and metrics.

Every metric is a row-level score expression followed by one aggregate
pass (partial aggregation on the map side), never a Python loop over rows.
Reports come out as one wide row; ``unpivot_report`` turns them into the
long ``(metric, value)`` table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .dialect import EVAL_TERMS, contained_terms, evaluator_vote, held_count


def unpivot_report(df: DataFrame, id_cols: list[str] | None = None) -> DataFrame:
    """Wide one-row report -> long (metric, value) table."""
    id_cols = id_cols or []
    vals = [c for c in df.columns if c not in id_cols]
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in vals]) \
        .unpivot(id_cols, vals, "metric", "value")


# ----------------------------------------------------------------- I1 / I2 / I8

def text_profile(df: DataFrame, text_cols: list[str] | None = None, split_col: str | None = None,
                 count_tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Count, char-length min/max/mean/median/pop-std and Arabic count and
    ratio per text column (auto: columns whose name contains 'text' or
    'content'); per split when ``split_col`` is given. With ``count_tokens``,
    a tokenizer's function from text to number of tokens, the same statistics
    of the tokens, over all rows."""
    cols = text_cols or [c for c in df.columns if "text" in c.lower() or "content" in c.lower()]
    aggs = [F.count(F.lit(1)).alias("num_examples")]
    for c in cols:
        ln = F.length(c)
        aggs += [F.min(ln).alias(f"{c}_min_length"), F.max(ln).alias(f"{c}_max_length"),
                 F.avg(ln).alias(f"{c}_mean_length"), F.median(ln).alias(f"{c}_median_length"),
                 F.stddev_pop(ln).alias(f"{c}_std_length"),
                 F.count_if(T.has_arabic(F.col(c))).alias(f"{c}_arabic_examples")]
        if count_tokens is not None:
            n = count_tokens(F.col(c))
            aggs += [F.min(n).alias(f"{c}_min_tokens"), F.max(n).alias(f"{c}_max_tokens"), F.avg(n).alias(f"{c}_mean_tokens"),
                     F.median(n).alias(f"{c}_median_tokens"), F.stddev_pop(n).alias(f"{c}_std_tokens")]
    g = df.groupBy(split_col).agg(*aggs) if split_col else df.agg(*aggs)
    return g.select("*", *[(F.col(f"{c}_arabic_examples") / F.col("num_examples")).alias(f"{c}_arabic_ratio")
                           for c in cols])


def word_length_percentiles(df: DataFrame, text_col: str, ps=(0.25, 0.75, 0.9, 0.95), exact: bool = True) -> DataFrame:
    """Word-count percentiles (linear interpolation); ``exact=False``
    switches to the sketch (``percentile_approx``) for very large inputs."""
    n = T.word_count(text_col)
    if exact:
        return df.agg(*[F.percentile(n, p).alias(f"p{int(p * 100)}") for p in ps],
                      F.avg(n).alias("mean_words"))
    return df.agg(*[F.percentile_approx(n, p, 10000).alias(f"p{int(p * 100)}") for p in ps],
                  F.avg(n).alias("mean_words"))


def length_stats(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """I8: mean, pop-std, min, max and the upper median sorted[n//2] over
    the lengths of both sides. The upper median is the smallest length whose
    cumulative count exceeds n//2, read off the length histogram."""
    lens = pairs.select(F.length(chosen).alias("len")).unionByName(pairs.select(F.length(rejected).alias("len")))
    st = lens.agg(F.avg("len").alias("mean"), F.stddev_pop("len").alias("std"), F.min("len").alias("min"),
                  F.max("len").alias("max"), F.count(F.lit(1)).alias("n"))
    hist = lens.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    cum = hist.select("len", F.sum("c").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    med = cum.crossJoin(F.broadcast(st.select("n"))).filter(F.col("cum") > F.floor(F.col("n") / 2)) \
        .agg(F.min("len").alias("median"))
    return st.crossJoin(med).drop("n")


# ----------------------------------------------------------------- I3 / I4 / I5 / I6 / I7

def sft_stats(df: DataFrame, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """Average and max instruction / response / total length (word
    tokens), over rows where both are non-empty."""
    ok = df.filter((F.coalesce(F.col(instruction), F.lit("")) != "") & (F.coalesce(F.col(response), F.lit("")) != ""))
    i, r = T.word_count(instruction), T.word_count(response)
    return ok.agg(F.avg(i).alias("avg_instruction_length"), F.avg(r).alias("avg_response_length"),
                  F.avg(i + r).alias("avg_total_length"), F.max(i).alias("max_instruction_length"),
                  F.max(r).alias("max_response_length"), F.max(i + r).alias("max_total_length"),
                  F.count(F.lit(1)).alias("samples_analyzed"))


def pairwise_stats(df: DataFrame) -> DataFrame:
    """I4: prompt/chosen/rejected average and max lengths, mean |chosen-rejected|."""
    ok = df.filter((F.coalesce(F.col("prompt"), F.lit("")) != "") & (F.coalesce(F.col("chosen"), F.lit("")) != "") &
                   (F.coalesce(F.col("rejected"), F.lit("")) != ""))
    p, c, r = T.word_count("prompt"), T.word_count("chosen"), T.word_count("rejected")
    return ok.agg(F.avg(p).alias("avg_prompt_length"), F.avg(c).alias("avg_chosen_length"),
                  F.avg(r).alias("avg_rejected_length"), F.avg(F.abs(c - r)).alias("avg_length_difference"),
                  F.max(p).alias("max_prompt_length"), F.max(c).alias("max_chosen_length"),
                  F.max(r).alias("max_rejected_length"), F.count(F.lit(1)).alias("samples_analyzed"))


def kto_stats(df: DataFrame, label: Column) -> DataFrame:
    """Prompt / completion lengths and the desirable ratio."""
    ok = df.filter((F.coalesce(F.col("prompt"), F.lit("")) != "") & (F.coalesce(F.col("completion"), F.lit("")) != ""))
    p, c = T.word_count("prompt"), T.word_count("completion")
    return ok.agg(F.avg(p).alias("avg_prompt_length"), F.avg(c).alias("avg_completion_length"),
                  F.max(p).alias("max_prompt_length"), F.max(c).alias("max_completion_length"),
                  F.avg(label.cast("double")).alias("desirable_ratio"), F.count(F.lit(1)).alias("samples_analyzed"))


def preference_profile(df: DataFrame) -> DataFrame:
    """Length ratio and diversity (1 - sim) mean/min/max/pop-std."""
    ratio = F.length("chosen") / F.greatest(F.length("rejected"), F.lit(1))
    div = 1.0 - T.sim("chosen", "rejected")
    s = df.select(ratio.alias("ratio"), div.alias("diversity"))
    out = []
    for c in ("ratio", "diversity"):
        out += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                F.stddev_pop(c).alias(f"{c}_std")]
    return s.agg(*out)


def sft_quality_metrics(df: DataFrame, instruction: str = "instruction", response: str = "response",
                        exact: bool = True) -> DataFrame:
    """Average lengths, Arabic share, duplicate ratio 1 - distinct/count
    (``exact=False`` uses the HyperLogLog sketch at scale)."""
    distinct = F.count_distinct(F.md5(instruction), F.md5(response)) if exact else F.approx_count_distinct(F.concat_ws("\u0001", instruction, response))
    return df.agg(F.avg(F.length(instruction)).alias("avg_instruction_chars"), F.avg(F.length(response)).alias("avg_response_chars"),
                  F.avg(T.has_arabic(F.col(instruction)).cast("double")).alias("arabic_ratio"),
                  (1.0 - distinct / F.count(F.lit(1))).alias("duplicate_ratio"))


# ----------------------------------------------------------------- I9 / I10 / I11

def instruction_report(df: DataFrame, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """Per instruction type count plus response word-length stats and
    format compliance mean and >0.5 rate (repeated on each type row)."""
    ok = df.filter((F.coalesce(F.col(instruction), F.lit("")) != "") & (F.coalesce(F.col(response), F.lit("")) != ""))
    s = ok.select(T.classify_instruction(F.col(instruction)).alias("instruction_type"),
                  T.word_count(response).alias("rlen"), T.format_compliance(instruction, response).alias("fc"))
    every = Window.partitionBy()
    g = s.groupBy("instruction_type").agg(F.count(F.lit(1)).alias("n"), F.sum("rlen").alias("sl"),
                                         F.sum(F.col("rlen") * F.col("rlen")).alias("sl2"),
                                         F.min("rlen").alias("mn"), F.max("rlen").alias("mx"),
                                         F.sum("fc").alias("sfc"), F.count_if(F.col("fc") > 0.5).alias("c5"))
    tot = F.sum("n").over(every)
    mean = F.sum("sl").over(every) / tot
    return g.select("instruction_type", "n", F.count(F.lit(1)).over(every).alias("total_types"),
                    mean.alias("avg_length"),
                    F.sqrt(F.greatest(F.sum("sl2").over(every) / tot - mean * mean, F.lit(0.0))).alias("std_length"),
                    F.min("mn").over(every).alias("min_length"), F.max("mx").over(every).alias("max_length"),
                    (F.sum("sfc").over(every) / tot).alias("avg_compliance"),
                    (F.sum("c5").over(every) / tot).alias("compliance_rate"))


def generation_basics(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Average word / char lengths, their ratio, distinct-prediction share
    (texts told apart by 128-bit digests, so no text is shuffled)."""
    return df.agg(F.avg(T.word_count(pred)).alias("avg_prediction_length"),
                  F.avg(T.word_count(ref)).alias("avg_reference_length"),
                  F.avg(F.length(pred)).alias("avg_prediction_char_length"),
                  F.avg(F.length(ref)).alias("avg_reference_char_length"),
                  (F.count_distinct(F.md5(pred)) / F.count(F.lit(1))).alias("prediction_diversity")) \
        .withColumn("length_ratio", F.col("avg_prediction_length") / F.greatest(F.col("avg_reference_length"), F.lit(1.0)))


def generation_quality(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Repetition (distinct/words over predictions with > 1 word),
    coherence min(|split('.')|/max(words,1), 1), and reference overlap
    |P ∩ R| / |R| of lower-cased word sets (rows with empty R skipped)."""
    w = T.py_words(pred)
    pw, rw = T.word_set(pred), T.word_set(ref)
    rep = F.when(F.size(w) > 1, F.size(F.array_distinct(w)) / F.size(w))
    rel = F.when(F.size(rw) > 0, F.size(F.array_intersect(pw, rw)) / F.size(rw))
    return df.agg(F.avg(rep).alias("avg_repetition_score"), F.avg(T.coherence_simple(pred)).alias("avg_coherence_score"),
                  F.avg(rel).alias("avg_relevance_score"))


# ----------------------------------------------------------------- I12 Arabic metrics

# Counts over a text whose white space is single spaces: each match starts
# where a word or sentence starts and runs to its end, so the number of
# matches is that of the words. Plain classes and no lambdas: a class of all
# Unicode spaces, negated, takes ten times as long for each character.
_COUNTS = {
    "words": "[^ ]++",
    "ar_words": f"[{L.AR2}][^ ]*+",
    "diac_words": f"[{L.HARAKAT}][^ ]*+",
    "long_words": "[^ ]{11,}+",
    "double_article": f"(?:^| ){L.DOUBLE_ARTICLE}",
    "marks": "[.!?]",
    "sentence_words": "[^ .!?]++",
    "full_sentences": "[^ .!?][^.!?]*+",
    # of three words at least
    "long_sentences": "(?<![^ .!?])(?:[^ .!?]++ ){2}[^ .!?][^.!?]*+",
}


def arabic_counts(df: DataFrame, text_col: str = "text", blocked_terms: list[str] | None = None) -> DataFrame:
    """The counts of each text from which I12's scores are made."""
    spaced = df.select(F.col(text_col).alias("t"), F.lower(F.col(text_col)).alias("low"),
                       F.regexp_replace(
        F.translate(F.col(text_col), T.WS_CHARS, " " * len(T.WS_CHARS)), "  +", " ").alias("spaced"))
    t, low, n = F.col("t"), F.col("low"), F.col("spaced")
    # words of five letters and more that start with an Arabic one, equal ones side by side
    keys = F.regexp_extract_all(n, F.lit(f"(?:^| )([{L.AR2}][^ ]{{4,}}+)"), F.lit(1))
    spaced = spaced.withColumn("keys", F.concat(F.lit(" "), F.array_join(F.sort_array(keys), " "), F.lit(" ")))
    # all terms in one projection; they are Arabic, so the lower-cased text holds the same ones
    spaced = spaced.withColumn("held", contained_terms(low, EVAL_TERMS + L.COHERENCE_CONNECTORS + L.RELIGIOUS_TERMS))
    held = F.col("held")
    hits = sum(held_count(held, L.EVAL_DIALECT_MARKERS[d]) for d in L.EVAL_DIALECT_ORDER)
    any_of = lambda text, terms: F.exists(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(text, x))
    return spaced.select(
        *[F.regexp_count(n, F.lit(p)).alias(k) for k, p in _COUNTS.items()],
        F.length(t).alias("chars"), F.length(F.replace(n, F.lit(" "), F.lit(""))).alias("word_chars"),
        T.letter_count(t).alias("letters"), T.arabic_letter_count(t).alias("ar_letters"), T.diacritic_count(t).alias("diacritics"),
        F.size(F.array_remove(F.array_distinct(F.split(n, " ")), "")).alias("distinct"),
        F.regexp_count("keys", F.lit(r" ([^ ]++)(?: \1(?= ))++")).alias("repeated"),
        t.rlike(f"[{L.AR2}]").alias("ar_any"), hits.alias("dialect_hits"), evaluator_vote(held).alias("dialect"),
        held_count(held, L.EVAL_FORMAL_INDICATORS).alias("formal_hits"),
        held_count(held, L.COHERENCE_CONNECTORS).alias("connectors"),
        (held_count(held, L.RELIGIOUS_TERMS) > 0).cast("double").alias("religious"),
        (F.lit(1.0) if not blocked_terms else (~any_of(low, blocked_terms)).cast("double")).alias("appropriate"))


def arabic_row_scores(counts: DataFrame, target_dialect: str = "msa", diacritics: bool = True) -> DataFrame:
    """Per-text parts of the Arabic report (I12a-j) from :func:`arabic_counts`."""
    c = F.col
    nw, n_clean = c("words"), c("full_sentences")
    latin = c("letters") - c("ar_letters")
    latin_ratio = latin / F.greatest(c("letters"), F.lit(1))
    avg_sent = c("sentence_words") / F.greatest(c("marks") + 1, F.lit(1))
    avg_wlen = F.try_divide(c("word_chars"), nw)
    has_punct = c("marks") > 0
    formality = c("formal_hits") / F.greatest(nw, F.lit(1)) * 0.4
    if diacritics:
        formality = formality + F.least(c("diacritics") / F.greatest(c("chars"), F.lit(1)), F.lit(0.1)) * 0.3
    formality = formality - c("dialect_hits") / F.greatest(nw, F.lit(1)) * 0.3 + F.when(avg_sent > 10, 0.2).otherwise(0.0)
    grammar = 1.0 - c("double_article") * 0.1 - (n_clean - c("long_sentences")) * 0.05
    fluency = (F.when((nw > 0) & (avg_wlen >= 3) & (avg_wlen <= 8), 0.3).otherwise(0.0)
               + F.when((avg_sent >= 5) & (avg_sent <= 20), 0.3).otherwise(0.0)
               + F.when((nw > 0) & (F.try_divide(c("distinct"), nw) > 0.7), 0.2).otherwise(0.0)
               + F.when(has_punct, 0.2).otherwise(0.0))
    coherence = F.when(n_clean > 1, F.least(F.try_divide(c("connectors"), n_clean), F.lit(0.5))
                       + F.least(F.try_divide(c("repeated"), n_clean), F.lit(0.5))).otherwise(F.lit(0.8))
    readability = F.when((nw > 0) & (n_clean > 0),
                         1.0 - F.when(avg_wlen > 8, 0.2).otherwise(0.0) - F.when(F.try_divide(nw, n_clean) > 15, 0.2).otherwise(0.0)
                         - F.try_divide(c("long_words"), nw) * 0.3
                         - F.when(~has_punct, 0.2).otherwise(0.0)).otherwise(F.lit(1.0))
    return counts.select(
        "ar_letters", "letters", "ar_words", "diac_words", "religious", "appropriate",
        ((c("ar_any") & ((latin <= 0) | (latin_ratio < 0.1))) | (~c("ar_any") & (latin > 0))).cast("double").alias("script_ok"),
        (c("dialect") == target_dialect).cast("double").alias("dialect_hit"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), formality)).alias("formality"),
        F.greatest(F.lit(0.0), grammar).alias("grammar"), fluency.alias("fluency"), coherence.alias("coherence"),
        F.greatest(F.lit(0.0), readability).alias("readability"))


def arabic_metrics(df: DataFrame, text_col: str = "text", target_dialect: str = "msa", diacritics: bool = True,
                   blocked_terms: list[str] | None = None, plugins: Sequence[str] = ()) -> DataFrame:
    """I12a-k: the Arabic report in one aggregate pass (one wide row).

    Cultural appropriateness has no patterns in the reference, so it is 1.0
    unless ``blocked_terms`` is given; religious sensitivity is always 1.0
    and the share of texts with a religious term is reported beside it.
    ``plugins`` names the caller's metrics (``hooks.register_metric``), a
    column each.
    """
    if plugins:
        from .hooks import evaluate
        own = evaluate(df, plugins).groupBy().pivot("metric", list(plugins)).agg(F.first("value"))
        return arabic_metrics(df, text_col, target_dialect, diacritics, blocked_terms).crossJoin(own)  # one row each
    rows = arabic_row_scores(arabic_counts(df, text_col, blocked_terms), target_dialect, diacritics)
    n = F.count(F.lit(1))
    agg = rows.agg(
        F.coalesce(F.try_divide(F.sum("ar_letters"), F.sum("letters")), F.lit(0.0)).alias("arabic_character_ratio"),
        (F.coalesce(F.try_divide(F.sum("diac_words"), F.sum("ar_words")), F.lit(0.0)) if diacritics else F.lit(0.0))
        .alias("diacritics_coverage"),
        F.coalesce(F.avg("script_ok"), F.lit(0.0)).alias("script_consistency"),
        F.coalesce(F.avg("dialect_hit"), F.lit(0.0)).alias("dialect_detection_accuracy"),
        F.coalesce(F.avg("formality"), F.lit(0.0)).alias("formality_score"),
        F.coalesce(F.avg("grammar"), F.lit(0.0)).alias("grammar_correctness"),
        F.coalesce(F.avg("appropriate"), F.lit(1.0)).alias("cultural_appropriateness"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.lit(1.0)).alias("religious_sensitivity"),
        F.coalesce(F.avg("religious"), F.lit(0.0)).alias("religious_term_share"),
        F.coalesce(F.avg("fluency"), F.lit(0.0)).alias("text_fluency"),
        F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("coherence_score"),
        F.coalesce(F.avg("readability"), F.lit(0.0)).alias("readability_score"),
        n.alias("n_texts"))
    return agg


def diacritization_accuracy(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Positional character match over the shorter whitespace-free text
    (micro over all rows)."""
    def chars(c):
        return F.array_remove(F.split(F.translate(c, T.WS_CHARS, ""), ""), "")

    def counts(c):
        agree = F.zip_with(c["p"], c["r"], lambda a, b: a == b)  # null beyond the shorter one
        return F.struct(F.least(F.size(c["p"]), F.size(c["r"])).alias("m"),
                        F.size(F.array_remove(F.array_compact(agree), False)).alias("s"))
    both = T.once(F.struct(chars(pred).alias("p"), chars(ref).alias("r")), counts)
    s = df.select(both.alias("both")).select("both.m", "both.s")
    return s.agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("m")), F.lit(0.0)).alias("diacritization_accuracy"),
                 F.sum("m").alias("chars_compared"))


# ----------------------------------------------------------------- I15-I20

def perplexity(df: DataFrame, logprob_sum: str, n_tokens: str, group_cols: list[str] | None = None) -> DataFrame:
    """exp(-sum(log p) / sum(tokens)), token-weighted, per group."""
    aggs = [F.exp(-F.sum(logprob_sum) / F.sum(n_tokens)).alias("perplexity"), F.sum(n_tokens).alias("tokens")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def preference_accuracy(scores: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """I16: share chosen > rejected; margin mean/pop-std/min/max/positive share."""
    m = F.col(chosen) - F.col(rejected)
    return scores.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("preference_accuracy"),
                      F.count(F.lit(1)).alias("n"), F.avg(m).alias("avg_margin"), F.stddev_pop(m).alias("std_margin"),
                      F.min(m).alias("min_margin"), F.max(m).alias("max_margin"),
                      F.avg((m > 0).cast("double")).alias("positive_margin_ratio"))


def kto_score_stats(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Mean / pop-std of the score per label, separation, label counts."""
    d = F.when(label, F.col(score))
    u = F.when(~label, F.col(score))
    return df.agg(F.count_if(label).alias("desirable"), F.count_if(~label).alias("undesirable"),
                  F.avg(label.cast("double")).alias("desirable_ratio"),
                  F.avg(d).alias("avg_desirable_score"), F.stddev_pop(d).alias("std_desirable_score"),
                  F.avg(u).alias("avg_undesirable_score"), F.stddev_pop(u).alias("std_undesirable_score")) \
        .withColumn("score_separation", F.col("avg_desirable_score") - F.col("avg_undesirable_score"))


def win_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """Response-quality heuristic (C19) of a vs b: wins/losses/ties/rates."""
    qa, qb = T.response_quality(a), T.response_quality(b)
    s = df.select(qa.alias("qa"), qb.alias("qb"))
    g = s.agg(F.count_if(F.col("qa") > F.col("qb")).alias("wins"), F.count_if(F.col("qa") < F.col("qb")).alias("losses"),
              F.count_if(F.col("qa") == F.col("qb")).alias("ties"))
    tot = F.col("wins") + F.col("losses") + F.col("ties")
    return g.select("*", *[F.when(tot > 0, F.col(c) / tot).otherwise(0.0).alias(f"{c[:-1] if c != 'losses' else 'loss'}_rate")
                           for c in ("wins", "losses", "ties")])


def _logsig(x: Column) -> Column:
    """log(sigmoid(x)) = -log1p(exp(-x)), written stably."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def preference_objectives(s: DataFrame, beta: float = 0.1, label_smoothing: float = 0.0, ipo_tau: float = 0.1,
                          cpo_alpha: float = 1.0, simpo_beta: float = 2.0, simpo_gamma_ratio: float = 0.5,
                          orpo_lambda: float = 0.1, desirable_weight: float = 1.0, undesirable_weight: float = 1.0,
                          cpo_simpo_gamma: float = 0.5) -> DataFrame:
    """Per-pair losses from policy/reference log-prob sums and token
    counts (lp_chosen, lp_rejected, ref_chosen, ref_rejected, n_chosen,
    n_rejected), then one aggregate row of means. Formulas are the published
    sigmoid-DPO, hinge, IPO, KTO, CPO, SimPO and ORPO objectives; CPO also
    with its hinge, ipo and simpo preference terms, KTO with the weights of
    the two classes and the share of each class on its side of the reference
    (``kto_accuracy_*``)."""
    pc, pr, rc, rr = F.col("lp_chosen"), F.col("lp_rejected"), F.col("ref_chosen"), F.col("ref_rejected")
    nc, nr = F.col("n_chosen").cast("double"), F.col("n_rejected").cast("double")
    h = (pc - rc) - (pr - rr)
    sig = -(1 - label_smoothing) * _logsig(beta * h) - label_smoothing * _logsig(-beta * h)
    hinge = F.greatest(F.lit(0.0), 1 - beta * h)
    hn = (pc / F.greatest(nc, F.lit(1.0)) - rc / F.greatest(nc, F.lit(1.0))) - \
        (pr / F.greatest(nr, F.lit(1.0)) - rr / F.greatest(nr, F.lit(1.0)))
    ipo = F.pow(hn - 1 / (2 * ipo_tau), 2)
    cpo = -_logsig(beta * (pc - pr)) + cpo_alpha * (-pc / F.greatest(nc, F.lit(1.0)))
    nll = cpo_alpha * (-pc / F.greatest(nc, F.lit(1.0)))
    cpo_hinge = F.greatest(F.lit(0.0), 1 - beta * (pc - pr)) + nll
    cpo_ipo = F.pow((pc - pr) - 1 / (2 * beta), 2) + nll
    cpo_simpo = -_logsig(beta * (pc / F.greatest(nc, F.lit(1.0)) - pr / F.greatest(nr, F.lit(1.0))) - cpo_simpo_gamma) + nll
    gamma = simpo_gamma_ratio * simpo_beta
    simpo = -_logsig(simpo_beta * (pc / F.greatest(nc, F.lit(1.0)) - pr / F.greatest(nr, F.lit(1.0))) - gamma)
    ac, ar = pc / F.greatest(nc, F.lit(1.0)), pr / F.greatest(nr, F.lit(1.0))
    log_odds = (ac - F.log1p(-F.exp(ac))) - (ar - F.log1p(-F.exp(ar)))
    orpo = -ac - orpo_lambda * _logsig(log_odds)
    # one aggregate row, joined back to every pair
    s = s.crossJoin(F.broadcast(s.agg(F.greatest(F.lit(0.0), F.avg(((pc - rc) + (pr - rr)) / 2)).alias("_kl"))))
    kl = F.col("_kl")
    kto_c = 1 - F.exp(_logsig(beta * (pc - rc) - kl))
    kto_r = 1 - F.exp(_logsig(-(beta * (pr - rr) - kl)))
    rows = s.select(sig.alias("sigmoid"), hinge.alias("hinge"), ipo.alias("ipo"), cpo.alias("cpo"), simpo.alias("simpo"),
                    orpo.alias("orpo"), ((desirable_weight * kto_c + undesirable_weight * kto_r) / 2).alias("kto"),
                    cpo_hinge.alias("cpo_hinge"), cpo_ipo.alias("cpo_ipo"), cpo_simpo.alias("cpo_simpo"),
                    (pc - rc > 0).cast("double").alias("good"), (pr - rr < 0).cast("double").alias("bad"), (beta * (pc - rc)).alias("reward_chosen"),
                    (beta * (pr - rr)).alias("reward_rejected"), (h > 0).cast("double").alias("acc"), kl.alias("kl"))
    return rows.agg(*[F.avg(c).alias(f"loss_{c}") for c in ("sigmoid", "hinge", "ipo", "cpo", "simpo", "orpo", "kto",
                                                                  "cpo_hinge", "cpo_ipo", "cpo_simpo")],
                    F.avg("good").alias("kto_accuracy_desirable"), F.avg("bad").alias("kto_accuracy_undesirable"),
                    F.avg("reward_chosen").alias("reward_chosen"), F.avg("reward_rejected").alias("reward_rejected"),
                    F.avg(F.col("reward_chosen") - F.col("reward_rejected")).alias("reward_margin"),
                    F.avg("acc").alias("reward_accuracy"), F.max("kl").alias("kl_estimate"))


def reward_calibration(s: DataFrame, beta: float = 0.1, bins: int = 10) -> DataFrame:
    """Per bin of the predicted probability that the chosen text wins,
    sigmoid(beta * margin): pairs, mean probability, share of pairs whose
    policy prefers the chosen text, and the gap between the two."""
    margin = (F.col("lp_chosen") - F.col("ref_chosen")) - (F.col("lp_rejected") - F.col("ref_rejected"))
    p = 1 / (1 + F.exp(-beta * margin))
    won = (F.col("lp_chosen") > F.col("lp_rejected")).cast("double")
    rows = s.select(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"), p.alias("p"), won.alias("won"))
    g = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("won").alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def margin_correlations(s: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Correlation of the reward margin with the difference in quality and in length of the two texts."""
    margin = F.col("lp_chosen") - F.col("lp_rejected")
    rows = s.select(margin.alias("m"), (T.quality(chosen) - T.quality(rejected)).alias("q"),
                    (F.length(chosen) - F.length(rejected)).cast("double").alias("l"))
    return rows.agg(F.corr("m", "q").alias("quality_corr"), F.corr("m", "l").alias("length_corr"), F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- I21-I27

def efficiency_table(runs: DataFrame) -> DataFrame:
    """Completed runs: efficiency = samples*epochs / max(seconds, .001),
    loss_score = 1 - loss when loss < 1 else 0, combined = product."""
    secs = F.regexp_extract("training_time", r"([0-9.]+)", 1).cast("double")
    done = runs.filter(F.col("status") == "completed")
    eff = F.col("samples_trained") * F.col("epochs") / F.greatest(secs, F.lit(0.001))
    ls = F.when(F.col("final_loss") < 1, 1 - F.col("final_loss")).otherwise(0.0)
    return done.select("method", "dataset", eff.alias("efficiency"), secs.alias("seconds"), "final_loss",
                       ls.alias("loss_score"), (eff * ls).alias("combined_score"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Total / completed / failed / success rate / total seconds."""
    secs = F.regexp_extract("training_time", r"([0-9.]+)", 1).cast("double")
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
                    F.count_if(F.col("status") != "completed").alias("failed"),
                    (F.count_if(F.col("status") == "completed") / F.count(F.lit(1))).alias("success_rate"),
                    F.sum(secs).alias("total_seconds"))


def method_dataset_report(runs: DataFrame) -> DataFrame:
    """Loss / efficiency / samples stats by method, by dataset and
    overall (GROUPING SETS), plus an above/below-average verdict."""
    e = efficiency_table(runs).join(runs.select("method", "dataset", "samples_trained"), ["method", "dataset"])
    rep = e.rollup("method").agg(F.avg("final_loss").alias("avg_loss"), F.min("final_loss").alias("min_loss"),
                                 F.max("final_loss").alias("max_loss"), F.stddev_pop("final_loss").alias("std_loss"),
                                 F.avg("efficiency").alias("avg_efficiency"), F.sum("samples_trained").alias("samples"))
    by_method = rep.select(F.when(F.col("method").isNull(), F.lit("overall")).otherwise(F.lit("method")).alias("level"),
                           F.coalesce("method", F.lit("*")).alias("key"), *[c for c in rep.columns if c != "method"])
    ds = e.groupBy("dataset").agg(F.avg("final_loss").alias("avg_loss"), F.min("final_loss").alias("min_loss"),
                                  F.max("final_loss").alias("max_loss"), F.stddev_pop("final_loss").alias("std_loss"),
                                  F.avg("efficiency").alias("avg_efficiency"), F.sum("samples_trained").alias("samples"))
    by_ds = ds.select(F.lit("dataset").alias("level"), F.col("dataset").alias("key"), *[c for c in ds.columns if c != "dataset"])
    allr = by_method.unionByName(by_ds)
    overall = F.max(F.when(F.col("level") == "overall", F.col("avg_efficiency"))).over(Window.partitionBy())
    return allr.withColumn("verdict", F.when(F.col("level") == "overall", F.lit("-"))
                           .when(F.col("avg_efficiency") >= overall, F.lit("above_average")).otherwise(F.lit("below_average")))


def latency_report(df: DataFrame, value_col: str, group_cols: list[str], key_col: str,
                   duration_col: str | None = None) -> DataFrame:
    """Mean and p50/p95/p99 as sorted[int(n*p)] (index form, exact),
    per group. Ranks come from the skew-proof grouped ranking, so a group
    holding most rows is still spread over many tasks."""
    from .ranking import grouped_row_number
    r = grouped_row_number(df.select(*group_cols, key_col, value_col), group_cols, [value_col, key_col], "__rn")
    n = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"))
    j = r.join(n, group_cols)
    aggs = [F.first("mean").alias("mean"), F.first("n").alias("n")]
    for p in (50, 95, 99):
        aggs.append(F.max(F.when(F.col("__rn") - 1 == F.floor(F.col("n") * (p / 100.0)), F.col(value_col))).alias(f"p{p}"))
    return j.groupBy(*group_cols).agg(*aggs)


def latency_sketch(df: DataFrame, value_col: str, group_cols: list[str], ps=(0.5, 0.95, 0.99), k: int = 800) -> DataFrame:
    """I24 for inputs too large to rank: percentiles from a KLL sketch per
    group, merged from the tasks' sketches; with ``k`` = 800 a value's rank
    is off by well under 1 % of the rows."""
    g = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"),
                                    F.kll_sketch_agg_double(F.col(value_col).cast("double"), k).alias("__s"))
    return g.select(*group_cols, "mean", "n", *[F.kll_sketch_get_quantile_double("__s", F.lit(float(p))).alias(f"p{int(p * 100)}") for p in ps])


def throughput(df: DataFrame, group_cols: list[str], start_us: Column, duration_us: Column, units: Column | None = None,
               num_partitions: int | None = None) -> DataFrame:
    """Requests (and ``units``, such as tokens) per busy second of each group.

    Busy time is the length of the union of the requests' intervals: a
    request adds what lies behind the latest end of all requests that start
    before it. That end is found inside slices of range partitions and
    carried across them by one row a slice, so a hot group is many tasks.
    """
    from .ranking import slices
    rows = df.select(*group_cols, start_us.cast("long").alias("_from"), (start_us + duration_us).cast("long").alias("_to"),
                     (units if units is not None else F.lit(0)).cast("long").alias("_units"))
    cut = slices(rows, group_cols, ["_from", "_to"], num_partitions)
    earlier = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*group_cols, "_pid").agg(F.max("_to").alias("_last")).withColumn("_before", F.max("_last").over(earlier)) \
        .select(*group_cols, "_pid", "_before")
    inside = Window.partitionBy(*group_cols, "_pid").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    known = cut.join(before, [*group_cols, "_pid"]).withColumn("_until", F.greatest("_before", F.max("_to").over(inside)))
    busy = F.greatest(F.lit(0), F.col("_to") - F.greatest("_from", "_until"))
    g = known.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("requests"), F.sum("_units").alias("units"), F.sum(busy).alias("_busy"))
    seconds = F.col("_busy") / 1e6
    return g.select(*group_cols, "requests", "units", seconds.alias("busy_seconds"),
                    F.try_divide("requests", seconds).alias("requests_per_second"), F.try_divide("units", seconds).alias("units_per_second"))


def stage_share(df: DataFrame, stage_col: str, value_col: str, threshold: float = 30.0) -> DataFrame:
    """Average per stage, percent of the total, bottleneck flag."""
    g = df.groupBy(stage_col).agg(F.avg(value_col).alias("avg"), F.sum(value_col).alias("total"))
    every = Window.partitionBy()
    pct = F.col("total") / F.sum("total").over(every) * 100.0
    return g.select(stage_col, "avg", pct.alias("percent"), (pct > threshold).alias("flag"),
                    (F.col("total") == F.max("total").over(every)).alias("primary_bottleneck"))


def dialect_rollup(df: DataFrame, dialect_col: str, metric_cols: list[str], plugins: Sequence[str] = ()) -> DataFrame:
    """Metrics by dialect plus the weighted overall row (ROLLUP);
    the overall mean is sum(n*m)/sum(n) = the mean over all rows. ``plugins``
    names the caller's metrics (``hooks.register_metric``), a column each."""
    out = df.rollup(dialect_col).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in metric_cols]) \
        .withColumn(dialect_col, F.coalesce(F.col(dialect_col), F.lit("overall")))
    if plugins:
        from .hooks import evaluate
        per = evaluate(df, plugins, [dialect_col]).unionByName(evaluate(df, plugins).withColumn(dialect_col, F.lit("overall")))
        out = out.join(per.groupBy(dialect_col).pivot("metric", list(plugins)).agg(F.first("value")), dialect_col, "left")
    return out


# ----------------------------------------------------------------- I14 text overlap metrics

def overlap_metrics(df: DataFrame, id_col: str, pred: str, ref: str, max_n: int = 4) -> DataFrame:
    """Exact match, token F1, corpus BLEU-1..4 (clipped n-gram counts,
    brevity penalty) and ROUGE-1/2 recall.

    N-grams are exploded to rows and counted per (row, n, gram) on both
    sides; the clipped overlap is sum(min(count_pred, count_ref)) from a
    full outer join of the two count tables. Everything is a shuffle of
    counts (map-side combined), never a quadratic per-row loop.
    """
    pw, rw = T.py_words(F.lower(F.col(pred))), T.py_words(F.lower(F.col(ref)))
    base = df.select(F.col(id_col).alias("rid"), pw.alias("pw"), rw.alias("rw"),
                     (T.py_strip(F.lower(F.col(pred))) == T.py_strip(F.lower(F.col(ref)))).cast("double").alias("em"))

    def grams(col):
        arrs = [F.struct(F.lit(1).alias("n"), F.col(col).alias("g"))] + \
               [F.struct(F.lit(n).alias("n"), T.ngrams(F.col(col), n).alias("g")) for n in range(2, max_n + 1)]
        e = base.select("rid", F.explode(F.array(*arrs)).alias("s")).select("rid", "s.n", F.explode("s.g").alias("gram"))
        return e.groupBy("rid", "n", "gram").agg(F.count(F.lit(1)).alias("c"))
    gp = grams("pw").withColumnRenamed("c", "cp")
    gr = grams("rw").withColumnRenamed("c", "cr")
    j = gp.join(gr, ["rid", "n", "gram"], "full_outer").fillna(0, ["cp", "cr"])
    per = j.groupBy("rid", "n").agg(F.sum(F.least("cp", "cr")).alias("m"), F.sum("cp").alias("p"), F.sum("cr").alias("r"))
    uni = per.filter(F.col("n") == 1).select("rid", F.col("m").alias("m1"), F.col("p").alias("p1"), F.col("r").alias("r1"))
    rows = base.select("rid", "em", F.size("pw").alias("plen"), F.size("rw").alias("rlen")).join(uni, "rid", "left") \
        .fillna(0, ["m1", "p1", "r1"])
    f1 = F.when((F.col("p1") == 0) | (F.col("r1") == 0), F.lit(0.0)).otherwise(2 * F.col("m1") / (F.col("p1") + F.col("r1")))
    head = rows.agg(F.avg("em").alias("exact_match"), F.avg(f1).alias("token_f1"), F.sum("plen").alias("c"),
                    F.sum("rlen").alias("r"))
    tot = per.groupBy().pivot("n", list(range(1, max_n + 1))).agg(F.sum("m").alias("M"), F.sum("p").alias("P"),
                                                                 F.sum("r").alias("R"))
    allr = head.crossJoin(tot)
    bp = F.when(F.col("c") > F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.greatest(F.col("c"), F.lit(1))))
    out = [F.col("exact_match"), F.col("token_f1")]
    logp = F.lit(0.0)
    zero = F.lit(False)
    for n in range(1, max_n + 1):
        m, pcount = F.coalesce(F.col(f"{n}_M"), F.lit(0)), F.coalesce(F.col(f"{n}_P"), F.lit(0))
        zero = zero | (m == 0)
        logp = logp + F.log(F.greatest(m / F.greatest(pcount, F.lit(1)), F.lit(1e-300)))
        out.append(F.when(zero, F.lit(0.0)).otherwise(bp * F.exp(logp / n)).alias(f"bleu_{n}"))
    out += [(F.coalesce(F.col("1_M"), F.lit(0)) / F.greatest(F.coalesce(F.col("1_R"), F.lit(0)), F.lit(1))).alias("rouge_1"),
            (F.coalesce(F.col("2_M"), F.lit(0)) / F.greatest(F.coalesce(F.col("2_R"), F.lit(0)), F.lit(1))).alias("rouge_2")]
    return allr.select(*out)


def rouge_l(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """I14 ROUGE-L F-measure averaged over the rows; the LCS is bit-parallel in an Arrow UDF."""
    from ..functions.udfs import lcs_length
    s = df.select(T.py_words(F.lower(F.col(pred))).alias("pw"), T.py_words(F.lower(F.col(ref))).alias("rw")) \
        .select(lcs_length("pw", "rw").alias("l"), F.size("pw").alias("pl"), F.size("rw").alias("rl"))
    p = F.col("l") / F.greatest(F.col("pl"), F.lit(1))
    r = F.col("l") / F.greatest(F.col("rl"), F.lit(1))
    return s.agg(F.avg(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("rouge_l"))


def utilisation_summary(records: DataFrame, list_col: str = "gpus", by: list[str] | None = None, min_gpu: float = 70.0,
                        min_memory: float = 80.0) -> DataFrame:
    """Mean utilisation over every device of every record, and the two
    advice flags (mean below ``min_gpu``, ``min_memory``). ``list_col`` is an
    array of structs with gpu_utilization and memory_utilization; records
    without devices count for nothing."""
    d = records.select(*(by or []), F.explode(list_col).alias("__d"))
    g = d.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg("__d.gpu_utilization").alias("avg_gpu"),
                                   F.avg("__d.memory_utilization").alias("avg_memory"))
    return g.select("*", (F.col("avg_gpu") < min_gpu).alias("low_gpu"), (F.col("avg_memory") < min_memory).alias("low_memory"))
