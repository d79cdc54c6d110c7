"""Metric queries (I*, W*) over the driver tables and the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import hooks as H
from ..operators import metrics as M
from ..operators import windows as WN
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register


def rall(df, skip=()):
    """Round every double column to 6 decimals (both engines do the same)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       and f.name not in skip else F.col(f.name) for f in df.schema.fields])


def R(x):
    return S.rnd(x)


# I1 ------------------------------------------------------------------------
def _i1_sql():
    ln = "length(text)"
    return S.with_views(
        f"SELECT lang AS split, count(*) AS num_examples, min({ln}) AS text_min_length, max({ln}) AS text_max_length, "
        f"{R(f'avg({ln})')} AS text_mean_length, {R(f'median({ln})')} AS text_median_length, "
        f"{R(f'stddev_pop({ln})')} AS text_std_length, min({S.nwords('text')}) AS text_min_tokens, max({S.nwords('text')}) AS "
        f"text_max_tokens, {R('avg(' + S.nwords('text') + ')')} AS text_mean_tokens, {R('median(' + S.nwords('text') + ')')} AS "
        f"text_median_tokens, {R('stddev_pop(' + S.nwords('text') + ')')} AS text_std_tokens, count_if({S.has_arabic('text')}) AS text_arabic_examples, "
        f"{R(f'count_if({S.has_arabic(chr(116) + chr(101) + chr(120) + chr(116))}) / count(*)')} AS text_arabic_ratio "
        "FROM ar_docs GROUP BY lang", "ar_docs")


@register("i1_text_profile", _i1_sql)
def i1_text_profile(spark, sf):
    d = TB.ar_docs(spark, sf).select(F.col("lang").alias("split"), "text")
    p = M.text_profile(d, ["text"], "split", T.word_count)  # the default tokenizer gives a token a word
    return rall(p.select("split", "num_examples", F.col("text_min_length").cast("long").alias("text_min_length"),
                         F.col("text_max_length").cast("long").alias("text_max_length"), "text_mean_length",
                         F.col("text_median_length").cast("double").alias("text_median_length"), "text_std_length",
                         F.col("text_min_tokens").cast("long").alias("text_min_tokens"),
                         F.col("text_max_tokens").cast("long").alias("text_max_tokens"), "text_mean_tokens", "text_median_tokens",
                         "text_std_tokens",
                         "text_arabic_examples", "text_arabic_ratio"))


# I2 ------------------------------------------------------------------------
@register("i2_word_percentiles",
          lambda: "SELECT " + ", ".join(f"{R(f'quantile_cont({S.nwords(chr(116) + chr(101) + chr(120) + chr(116))}, {p})')} AS p{int(p * 100)}"
                                         for p in (0.25, 0.75, 0.9, 0.95)) +
                  f", {R(f'avg({S.nwords(chr(116) + chr(101) + chr(120) + chr(116))})')} AS mean_words FROM documents")
def i2_word_percentiles(spark, sf):
    return rall(M.word_length_percentiles(TB.table(spark, sf, "documents"), "text"))


# I3 / I4 / I5 / I6 / I7 / I8 -----------------------------------------------
@register("i3_sft_stats",
          lambda: S.with_views(
              f"SELECT {R('avg(i)')} AS avg_instruction_length, {R('avg(r)')} AS avg_response_length, {R('avg(i + r)')} "
              "AS avg_total_length, max(i) AS max_instruction_length, max(r) AS max_response_length, max(i + r) AS "
              "max_total_length, count(*) AS samples_analyzed FROM (SELECT CAST(" + S.nwords("instruction") + " AS INTEGER) AS i, CAST("
              + S.nwords("response") + " AS INTEGER) AS r FROM sft WHERE coalesce(instruction, '') <> '' AND coalesce(response, '') <> '') x",
              "sft"))
def i3_sft_stats(spark, sf):
    return rall(M.sft_stats(TB.sft(spark, sf)))


@register("i4_pairwise_stats",
          lambda: S.with_views(
              f"SELECT {R('avg(p)')} AS avg_prompt_length, {R('avg(c)')} AS avg_chosen_length, {R('avg(r)')} AS avg_rejected_length, "
              f"{R('avg(abs(c - r))')} AS avg_length_difference, max(p) AS max_prompt_length, max(c) AS max_chosen_length, "
              "max(r) AS max_rejected_length, count(*) AS samples_analyzed FROM (SELECT CAST(" + S.nwords("prompt") +
              " AS INTEGER) AS p, CAST(" + S.nwords("chosen") + " AS INTEGER) AS c, CAST(" + S.nwords("rejected") +
              " AS INTEGER) AS r FROM pairs WHERE coalesce(prompt, '') <> '' AND coalesce(chosen, '') <> '' AND "
              "coalesce(rejected, '') <> '') x", "pairs"))
def i4_pairwise_stats(spark, sf):
    return rall(M.pairwise_stats(TB.pairs(spark, sf)))


@register("i5_kto_stats",
          lambda: S.with_views(
              f"SELECT {R('avg(p)')} AS avg_prompt_length, {R('avg(c)')} AS avg_completion_length, max(p) AS max_prompt_length, "
              f"max(c) AS max_completion_length, {R('avg(CAST(label AS DOUBLE))')} AS desirable_ratio, count(*) AS samples_analyzed "
              "FROM (SELECT CAST(" + S.nwords("prompt") + " AS INTEGER) AS p, CAST(" + S.nwords("completion") +
              " AS INTEGER) AS c, label FROM kto WHERE coalesce(prompt, '') <> '' AND coalesce(completion, '') <> '') x", "kto"))
def i5_kto_stats(spark, sf):
    return rall(M.kto_stats(TB.kto(spark, sf), F.col("label") == 1))


@register("i6_preference_profile",
          lambda: S.with_views(
              "SELECT " + ", ".join(f"{R(f'{a}({c})')} AS {c}_{n}" for c in ("ratio", "diversity")
                                    for a, n in (("avg", "mean"), ("min", "min"), ("max", "max"), ("stddev_pop", "std"))) +
              " FROM (SELECT length(chosen) / CAST(greatest(length(rejected), 1) AS DOUBLE) AS ratio, 1.0 - " +
              S.sim("chosen", "rejected") + " AS diversity FROM pairs) x", "pairs"))
def i6_preference_profile(spark, sf):
    return rall(M.preference_profile(TB.pairs(spark, sf)))


@register("i7_sft_quality_metrics",
          lambda: S.with_views(
              f"SELECT {R('avg(length(instruction))')} AS avg_instruction_chars, {R('avg(length(response))')} AS avg_response_chars, "
              f"{R('avg(CAST(' + S.has_arabic('instruction') + ' AS DOUBLE))')} AS arabic_ratio, "
              f"{R('1.0 - count(DISTINCT (instruction, response)) / count(*)')} AS duplicate_ratio FROM sft", "sft"))
def i7_sft_quality_metrics(spark, sf):
    return rall(M.sft_quality_metrics(TB.sft(spark, sf)))


@register("i8_length_stats",
          lambda: S.with_views(
              f"SELECT {R('avg(len)')} AS mean, {R('stddev_pop(len)')} AS std, min(len) AS min, max(len) AS max, "
              "(SELECT len FROM (SELECT len, row_number() OVER (ORDER BY len) AS rn, count(*) OVER () AS n FROM l) z "
              "WHERE rn = floor(n / 2) + 1) AS median FROM l", "pairs",
              extra=[("l", "SELECT CAST(length(chosen) AS INTEGER) AS len FROM pairs UNION ALL "
                           "SELECT CAST(length(rejected) AS INTEGER) FROM pairs")]))
def i8_length_stats(spark, sf):
    return rall(M.length_stats(TB.pairs(spark, sf)))


# I9 / I10 / I11 ------------------------------------------------------------
def _i9_sql():
    body = ("SELECT instruction_type, n, count(*) OVER () AS total_types, "
            f"{R('sum(sl) OVER () / sum(n) OVER ()')} AS avg_length, "
            f"{R('sqrt(greatest(sum(sl2) OVER () / sum(n) OVER () - pow(sum(sl) OVER () / sum(n) OVER (), 2), 0.0))')} AS std_length, "
            "min(mn) OVER () AS min_length, max(mx) OVER () AS max_length, "
            f"{R('sum(sfc) OVER () / sum(n) OVER ()')} AS avg_compliance, {R('sum(c5) OVER () / sum(n) OVER ()')} AS compliance_rate "
            "FROM (SELECT instruction_type, count(*) AS n, sum(rlen) AS sl, sum(rlen * rlen) AS sl2, min(rlen) AS mn, "
            "max(rlen) AS mx, sum(fc) AS sfc, count_if(fc > 0.5) AS c5 FROM (SELECT "
            f"{S.classify_instruction('instruction')} AS instruction_type, CAST({S.nwords('response')} AS INTEGER) AS rlen, "
            f"{S.format_compliance('instruction', 'response')} AS fc FROM sft WHERE coalesce(instruction, '') <> '' AND "
            "coalesce(response, '') <> '') a GROUP BY instruction_type) g")
    return S.with_views(body, "sft")


@register("i9_instruction_report", _i9_sql)
def i9_instruction_report(spark, sf):
    r = M.instruction_report(TB.sft(spark, sf))
    return rall(r.select("instruction_type", "n", "total_types", "avg_length", "std_length",
                         F.col("min_length").cast("int").alias("min_length"), F.col("max_length").cast("int").alias("max_length"),
                         "avg_compliance", "compliance_rate"))


def _gen_src(spark, sf):
    return TB.sft(spark, sf).select(F.col("response").alias("prediction"), F.col("instruction").alias("reference"))


@register("i10_generation_basics",
          lambda: S.with_views(
              f"SELECT {R('avg(' + S.nwords('response') + ')')} AS avg_prediction_length, {R('avg(' + S.nwords('instruction') + ')')} "
              f"AS avg_reference_length, {R('avg(length(response))')} AS avg_prediction_char_length, "
              f"{R('avg(length(instruction))')} AS avg_reference_char_length, {R('count(DISTINCT response) / count(*)')} AS "
              f"prediction_diversity, {R('avg(' + S.nwords('response') + ') / greatest(avg(' + S.nwords('instruction') + '), 1.0)')} "
              "AS length_ratio FROM sft", "sft"))
def i10_generation_basics(spark, sf):
    return rall(M.generation_basics(_gen_src(spark, sf)))


@register("i11_generation_quality",
          lambda: S.with_views(
              f"SELECT {R('avg(CASE WHEN len(' + S.words('response') + ') > 1 THEN CAST(len(list_distinct(' + S.words('response') + ')) AS DOUBLE) / len(' + S.words('response') + ') END)')} "
              f"AS avg_repetition_score, {R('avg(' + S.coherence_simple('response') + ')')} AS avg_coherence_score, "
              f"{R('avg(CASE WHEN len(' + S.word_set('instruction') + ') > 0 THEN CAST(len(list_intersect(' + S.word_set('response') + ', ' + S.word_set('instruction') + ')) AS DOUBLE) / len(' + S.word_set('instruction') + ') END)')} "
              "AS avg_relevance_score FROM sft", "sft"))
def i11_generation_quality(spark, sf):
    return rall(M.generation_quality(_gen_src(spark, sf)))


# I12 -----------------------------------------------------------------------
def _i12_sql():
    sc = S.arabic_row_scores("text")
    inner = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in sc.items()) + " FROM ar_docs"
    body = (f"SELECT {R('coalesce(CASE WHEN sum(letters) = 0 THEN NULL ELSE sum(ar_letters) / sum(letters) END, 0.0)')} AS arabic_character_ratio, "
            f"{R('coalesce(CASE WHEN sum(ar_words) = 0 THEN NULL ELSE sum(diac_words) / sum(ar_words) END, 0.0)')} AS diacritics_coverage, "
            f"{R('coalesce(avg(script_ok), 0.0)')} AS script_consistency, {R('coalesce(avg(dialect_hit), 0.0)')} AS dialect_detection_accuracy, "
            f"{R('coalesce(avg(formality), 0.0)')} AS formality_score, {R('coalesce(avg(grammar), 0.0)')} AS grammar_correctness, "
            "1.0 AS cultural_appropriateness, 1.0 AS religious_sensitivity, "
            f"{R('coalesce(avg(religious), 0.0)')} AS religious_term_share, {R('coalesce(avg(fluency), 0.0)')} AS text_fluency, "
            f"{R('coalesce(avg(coherence), 0.0)')} AS coherence_score, {R('coalesce(avg(readability), 0.0)')} AS readability_score, "
            f"count(*) AS n_texts FROM ({inner}) x")
    return S.with_views(body, "ar_docs")


@register("i12_arabic_metrics", _i12_sql)
def i12_arabic_metrics(spark, sf):
    return rall(M.arabic_metrics(TB.ar_docs(spark, sf)))


BLOCKED_TERMS = ["تثج", "صاحبي", "مرحبا"]


@register("i12_blocked_terms",
          lambda: S.with_views("SELECT round(avg(CAST(NOT (" + " OR ".join(f"contains(lower(text), {S.q(t)})" for t in BLOCKED_TERMS) +
                               ") AS DOUBLE)), 6) AS cultural_appropriateness, count(*) AS n_texts FROM ar_docs", "ar_docs"))
def i12_blocked_terms(spark, sf):
    """I12f with a list of blocked terms."""
    m = M.arabic_metrics(TB.ar_docs(spark, sf), blocked_terms=BLOCKED_TERMS)
    return m.select(F.round("cultural_appropriateness", 6).alias("cultural_appropriateness"), "n_texts")


def _i12_table_sql():
    names = ["arabic_character_ratio", "diacritics_coverage", "script_consistency", "dialect_detection_accuracy", "formality_score",
             "grammar_correctness", "cultural_appropriateness", "religious_sensitivity", "religious_term_share", "text_fluency",
             "coherence_score", "readability_score", "n_texts"]
    one = _i12_sql()
    return (f"WITH rep AS ({one}) SELECT unnest([{', '.join(S.q(n) for n in names)}]) AS metric, "
            f"unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in names)}]) AS value FROM rep")


@register("i12_arabic_metric_table", _i12_table_sql)
def i12_arabic_metric_table(spark, sf):
    """I12k: the same report as a long (metric, value) table."""
    return M.unpivot_report(M.arabic_metrics(TB.ar_docs(spark, sf))).withColumn("value", F.round("value", 6))


# I13 -----------------------------------------------------------------------
def _i13_sql():
    p = f"list_filter(string_split({S.rr('p', S.WS_RUN)}, ''), lambda c: c <> '')"
    r = f"list_filter(string_split({S.rr('r', S.WS_RUN)}, ''), lambda c: c <> '')"
    m = f"least(len({p}), len({r}))"
    same = f"len(list_filter(list_zip({p}, {r})[1:{m}], lambda z: z[1] = z[2]))"
    return S.with_views(f"SELECT {R(f'coalesce(CASE WHEN sum(m) = 0 THEN NULL ELSE sum(s) / sum(m) END, 0.0)')} AS diacritization_accuracy, "
                        f"sum(m) AS chars_compared FROM (SELECT {m} AS m, {same} AS s FROM (SELECT "
                        f"{S.rr('text', '[' + L.HARAKAT + ']')} AS p, text AS r FROM ar_docs) a) x", "ar_docs")


@register("i13_diacritization_accuracy", _i13_sql)
def i13_diacritization_accuracy(spark, sf):
    d = TB.ar_docs(spark, sf).select(F.regexp_replace("text", f"[{L.HARAKAT}]", "").alias("p"), F.col("text").alias("r"))
    a = M.diacritization_accuracy(d, "p", "r")
    return rall(a.select("diacritization_accuracy", F.col("chars_compared").cast("long").alias("chars_compared")))


# I15-I20 -------------------------------------------------------------------
@register("i15_perplexity",
          lambda: S.with_views(f"SELECT {R('exp(-sum(lp_chosen) / sum(n_chosen))')} AS perplexity, sum(n_chosen) AS tokens "
                               "FROM scores", "scores"))
def i15_perplexity(spark, sf):
    p = M.perplexity(TB.scores(spark, sf), "lp_chosen", "n_chosen")
    return rall(p.select("perplexity", F.col("tokens").cast("long").alias("tokens")))


@register("i16_preference_accuracy",
          lambda: S.with_views(
              f"SELECT {R('avg(CAST(lp_chosen > lp_rejected AS DOUBLE))')} AS preference_accuracy, count(*) AS n, "
              f"{R('avg(m)')} AS avg_margin, {R('stddev_pop(m)')} AS std_margin, {R('min(m)')} AS min_margin, {R('max(m)')} AS max_margin, "
              f"{R('avg(CAST(m > 0 AS DOUBLE))')} AS positive_margin_ratio FROM (SELECT *, lp_chosen - lp_rejected AS m FROM scores) x",
              "scores"))
def i16_preference_accuracy(spark, sf):
    return rall(M.preference_accuracy(TB.scores(spark, sf), "lp_chosen", "lp_rejected"))


@register("i17_kto_score_stats",
          lambda: S.with_views(
              "SELECT count_if(label = 1) AS desirable, count_if(label <> 1) AS undesirable, "
              f"{R('avg(CAST(label = 1 AS DOUBLE))')} AS desirable_ratio, {R('avg(CASE WHEN label = 1 THEN s END)')} AS avg_desirable_score, "
              f"{R('stddev_pop(CASE WHEN label = 1 THEN s END)')} AS std_desirable_score, {R('avg(CASE WHEN label <> 1 THEN s END)')} "
              f"AS avg_undesirable_score, {R('stddev_pop(CASE WHEN label <> 1 THEN s END)')} AS std_undesirable_score, "
              f"{R('avg(CASE WHEN label = 1 THEN s END) - avg(CASE WHEN label <> 1 THEN s END)')} AS score_separation FROM "
              f"(SELECT label, {S.quality('completion')} AS s FROM kto) x", "kto"))
def i17_kto_score_stats(spark, sf):
    k = TB.kto(spark, sf).withColumn("s", T.quality("completion"))
    return rall(M.kto_score_stats(k, "s", F.col("label") == 1))


@register("i18_win_rate",
          lambda: S.with_views(
              "SELECT wins, losses, ties, " + ", ".join(
                  f"{R(f'CASE WHEN wins + losses + ties > 0 THEN {c} / (wins + losses + ties) ELSE 0.0 END')} AS {n}"
                  for c, n in (("wins", "win_rate"), ("losses", "loss_rate"), ("ties", "tie_rate"))) +
              " FROM (SELECT count_if(qa > qb) AS wins, count_if(qa < qb) AS losses, count_if(qa = qb) AS ties FROM "
              f"(SELECT {S.response_quality('chosen')} AS qa, {S.response_quality('rejected')} AS qb FROM pairs) x) y", "pairs"))
def i18_win_rate(spark, sf):
    return rall(M.win_rate(TB.pairs(spark, sf), "chosen", "rejected"))


def _i19_sql():
    b, ls = 0.1, 0.0

    def logsig(x):
        return f"(least({x}, 0.0) - ln(1 + exp(-abs({x}))))"
    h = "((lp_chosen - ref_chosen) - (lp_rejected - ref_rejected))"
    nc, nr = "greatest(CAST(n_chosen AS DOUBLE), 1.0)", "greatest(CAST(n_rejected AS DOUBLE), 1.0)"
    hn = f"((lp_chosen / {nc} - ref_chosen / {nc}) - (lp_rejected / {nr} - ref_rejected / {nr}))"
    ac, ar = f"(lp_chosen / {nc})", f"(lp_rejected / {nr})"
    lo = f"(({ac} - ln(1 - exp({ac}))) - ({ar} - ln(1 - exp({ar}))))"
    kl = "greatest(0.0, avg(((lp_chosen - ref_chosen) + (lp_rejected - ref_rejected)) / 2) OVER ())"
    rows = (f"SELECT -(1 - {ls}) * {logsig(f'{b} * {h}')} - {ls} * {logsig(f'-{b} * {h}')} AS sigmoid, "
            f"greatest(0.0, 1 - {b} * {h}) AS hinge, pow({hn} - 1 / (2 * 0.1), 2) AS ipo, "
            f"-{logsig(f'{b} * (lp_chosen - lp_rejected)')} + 1.0 * (-lp_chosen / {nc}) AS cpo, "
            f"-{logsig(f'2.0 * ({ac} - {ar}) - 1.0')} AS simpo, -{ac} - 0.1 * {logsig(lo)} AS orpo, "
            f"greatest(0.0, 1 - {b} * (lp_chosen - lp_rejected)) - lp_chosen / {nc} AS cpo_hinge, "
            f"pow((lp_chosen - lp_rejected) - 1 / (2 * {b}), 2) - lp_chosen / {nc} AS cpo_ipo, "
            f"-{logsig(f'({b} * ({ac} - {ar}) - 0.5)')} - lp_chosen / {nc} AS cpo_simpo, "
            "CAST(lp_chosen > ref_chosen AS DOUBLE) AS good, CAST(lp_rejected < ref_rejected AS DOUBLE) AS bad, "
            f"{b} * (lp_chosen - ref_chosen) AS reward_chosen, {b} * (lp_rejected - ref_rejected) AS reward_rejected, "
            f"CAST({h} > 0 AS DOUBLE) AS acc, lp_chosen, ref_chosen, lp_rejected, ref_rejected, {kl} AS kl FROM scores")
    kto = (f"(1.5 * (1 - exp({logsig(f'{b} * (lp_chosen - ref_chosen) - kl')})) + "
           f"0.75 * (1 - exp({logsig(f'-({b} * (lp_rejected - ref_rejected) - kl)')}))) / 2")
    body = ("SELECT " + ", ".join(f"{R(f'avg({c})')} AS loss_{c}" for c in ("sigmoid", "hinge", "ipo", "cpo", "simpo", "orpo", "cpo_hinge", "cpo_ipo", "cpo_simpo")) +
            f", {R('avg(good)')} AS kto_accuracy_desirable, {R('avg(bad)')} AS kto_accuracy_undesirable, {R(f'avg({kto})')} AS loss_kto, {R('avg(reward_chosen)')} AS reward_chosen, {R('avg(reward_rejected)')} AS reward_rejected, "
            f"{R('avg(reward_chosen - reward_rejected)')} AS reward_margin, {R('avg(acc)')} AS reward_accuracy, "
            f"{R('first(kl)')} AS kl_estimate FROM r")
    return S.with_views(body, "scores", extra=[("r", rows)])


@register("i19_preference_objectives", _i19_sql)
def i19_preference_objectives(spark, sf):
    return rall(M.preference_objectives(TB.scores(spark, sf), desirable_weight=1.5, undesirable_weight=0.75))


@register("i20_length_bias_slices",
          lambda: S.with_views(
              f"SELECT bucket, count(*) AS n, {R('avg(CAST(lp_chosen > lp_rejected AS DOUBLE))')} AS accuracy, "
              f"{R('corr(lp_chosen - lp_rejected, CAST(n_chosen - n_rejected AS DOUBLE))')} AS margin_length_corr FROM "
              "(SELECT *, CASE WHEN n_chosen >= n_rejected THEN 'chosen_longer' ELSE 'chosen_shorter' END AS bucket FROM scores) x "
              "GROUP BY bucket", "scores"))
def i20_length_bias_slices(spark, sf):
    s = TB.scores(spark, sf)
    b = F.when(F.col("n_chosen") >= F.col("n_rejected"), F.lit("chosen_longer")).otherwise(F.lit("chosen_shorter"))
    g = s.groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("lp_chosen") > F.col("lp_rejected")).cast("double")).alias("accuracy"),
        F.corr(F.col("lp_chosen") - F.col("lp_rejected"), (F.col("n_chosen") - F.col("n_rejected")).cast("double"))
        .alias("margin_length_corr"))
    return rall(g)


_MARGIN = "((lp_chosen - ref_chosen) - (lp_rejected - ref_rejected))"


@register("i20_reward_calibration",
          lambda: S.with_views(
              f"SELECT bin, n, {R('confidence')} AS confidence, {R('accuracy')} AS accuracy, {R('abs(confidence - accuracy)')} AS gap FROM ("
              "SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS confidence, avg(won) AS accuracy FROM ("
              f"SELECT 1 / (1 + exp(-0.1 * {_MARGIN})) AS p, CAST(lp_chosen > lp_rejected AS DOUBLE) AS won FROM scores) x GROUP BY 1) y",
              "scores"))
def i20_reward_calibration(spark, sf):
    return rall(M.reward_calibration(TB.scores(spark, sf)))


@register("i20_margin_correlations",
          lambda: S.with_views(
              f"SELECT {R('corr(m, q)')} AS quality_corr, {R('corr(m, l)')} AS length_corr, count(*) AS n FROM (SELECT lp_chosen - lp_rejected "
              f"AS m, {S.quality('chosen')} - {S.quality('rejected')} AS q, CAST(length(chosen) - length(rejected) AS DOUBLE) AS l "
              "FROM scores JOIN pairs USING (id)) x", "scores"))
def i20_margin_correlations(spark, sf):
    s = TB.scores(spark, sf).join(TB.pairs(spark, sf).select("id", "chosen", "rejected"), "id")
    return rall(M.margin_correlations(s))


# I21-I25, I27, I28 ---------------------------------------------------------
def _eff_cols():
    t = "CAST(regexp_extract(training_time, '([0-9.]+)', 1) AS DOUBLE)"
    eff = f"samples_trained * epochs / greatest({t}, 0.001)"
    ls = "CASE WHEN final_loss < 1 THEN 1 - final_loss ELSE 0.0 END"
    return t, eff, ls


@register("i21_training_efficiency",
          lambda: S.with_views(
              "SELECT method, dataset, {e} AS efficiency, {t} AS seconds, final_loss, {l} AS loss_score, {c} AS combined_score "
              "FROM runs WHERE status = 'completed'".format(
                  e=R(_eff_cols()[1]), t=R(_eff_cols()[0]), l=R(_eff_cols()[2]), c=R(f"({_eff_cols()[1]}) * ({_eff_cols()[2]})")),
              "runs"))
def i21_training_efficiency(spark, sf):
    return rall(M.efficiency_table(TB.runs(spark, sf)))


@register("i22_run_summary",
          lambda: S.with_views(
              "SELECT count(*) AS total, count_if(status = 'completed') AS completed, count_if(status <> 'completed') AS failed, "
              f"{R('count_if(status = ' + S.q('completed') + ') / count(*)')} AS success_rate, "
              f"{R('sum(' + _eff_cols()[0] + ')')} AS total_seconds FROM runs", "runs"))
def i22_run_summary(spark, sf):
    return rall(M.run_summary(TB.runs(spark, sf)))


def _i23_sql():
    t, eff, _ = _eff_cols()
    stats = (f"{R('avg(final_loss)')} AS avg_loss, {R('min(final_loss)')} AS min_loss, {R('max(final_loss)')} AS max_loss, "
             f"{R('stddev_pop(final_loss)')} AS std_loss, {R('avg(efficiency)')} AS avg_efficiency, sum(samples_trained) AS samples")
    body = ("WITH e AS (SELECT method, dataset, final_loss, samples_trained, " + eff + " AS efficiency FROM runs WHERE status = 'completed'), "
            "a AS (SELECT CASE WHEN grouping(method) = 1 THEN 'overall' ELSE 'method' END AS level, coalesce(method, '*') AS key, "
            f"{stats} FROM e GROUP BY ROLLUP (method) UNION ALL SELECT 'dataset', dataset, {stats} FROM e GROUP BY dataset) "
            "SELECT *, CASE WHEN level = 'overall' THEN '-' WHEN avg_efficiency >= max(CASE WHEN level = 'overall' THEN avg_efficiency END) "
            "OVER () THEN 'above_average' ELSE 'below_average' END AS verdict FROM a")
    return S.with_views(body, "runs")


@register("i23_method_dataset_report", _i23_sql)
def i23_method_dataset_report(spark, sf):
    return rall(M.method_dataset_report(TB.runs(spark, sf)))


@register("i24_latency_percentiles",
          lambda: "SELECT event_type, avg_v AS mean, n, max(CASE WHEN rn - 1 = floor(n * 0.5) THEN value END) AS p50, "
                  "max(CASE WHEN rn - 1 = floor(n * 0.95) THEN value END) AS p95, max(CASE WHEN rn - 1 = floor(n * 0.99) THEN value END) "
                  "AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, "
                  "count(*) OVER (PARTITION BY event_type) AS n, round(avg(value) OVER (PARTITION BY event_type), 6) AS avg_v FROM events) x "
                  "GROUP BY event_type, avg_v, n")
def i24_latency_percentiles(spark, sf):
    e = TB.table(spark, sf, "events")
    r = M.latency_report(e, "value", ["event_type"], "event_id")
    return r.select("event_type", F.round("mean", 6).alias("mean"), "n", "p50", "p95", "p99")


@register("i24_latency_sketch")
def i24_latency_sketch(spark, sf):
    """The percentiles from mergeable sketches; a test bounds their rank error."""
    return M.latency_sketch(TB.table(spark, sf, "events"), "value", ["event_type"])


@register("i24_throughput",
          lambda: "SELECT event_type, requests, units, round(busy / 1e6, 6) AS busy_seconds, round(requests / (busy / 1e6), 6) AS "
                  "requests_per_second, round(units / (busy / 1e6), 6) AS units_per_second FROM (SELECT event_type, count(*) AS requests, "
                  "CAST(sum(user_id) AS BIGINT) AS units, sum(greatest(0, t1 - greatest(t0, coalesce(until, t0)))) AS busy FROM ("
                  "SELECT *, max(t1) OVER (PARTITION BY event_type ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until "
                  "FROM (SELECT event_type, user_id, epoch_us(ts) AS t0, epoch_us(ts) + CAST(floor(value * 60 * 1000000) AS BIGINT) AS t1 "
                  "FROM events) e) x GROUP BY event_type) y")
def i24_throughput(spark, sf):
    """Events as requests of ``value`` minutes with user_id as their size."""
    e = TB.table(spark, sf, "events")
    t = M.throughput(e, ["event_type"], F.unix_micros(F.col("ts").cast("timestamp")), F.floor(F.col("value") * 60 * 1000000), F.col("user_id"))
    return rall(t)


@register("i25_stage_share",
          lambda: "SELECT event_type, round(avg_v, 6) AS avg, round(pct, 6) AS percent, pct > 30.0 AS flag, "
                  "total = max(total) OVER () AS primary_bottleneck FROM (SELECT event_type, avg(value) AS avg_v, sum(value) AS total, "
                  "sum(value) / sum(sum(value)) OVER () * 100.0 AS pct FROM events GROUP BY event_type) x")
def i25_stage_share(spark, sf):
    s = M.stage_share(TB.table(spark, sf, "events"), "event_type", "value")
    return s.select("event_type", F.round("avg", 6).alias("avg"), F.round("percent", 6).alias("percent"), "flag",
                    "primary_bottleneck")


@register("i27_dialect_rollup",
          lambda: S.with_views(
              f"SELECT coalesce(dialect, 'overall') AS dialect, count(*) AS n, {R('avg(confidence)')} AS confidence, "
              f"{R('avg(CAST(length(text) AS DOUBLE))')} AS chars FROM tagged GROUP BY ROLLUP (dialect)", "ar_docs",
              extra=[("tagged", S.detect_dialect_select("ar_docs", keep="doc_id, text"))]))
def i27_dialect_rollup(spark, sf):
    from ..operators.dialect import detect_dialect
    t = detect_dialect(TB.ar_docs(spark, sf)).withColumn("chars", F.length("text").cast("double"))
    return rall(M.dialect_rollup(t, "dialect", ["confidence", "chars"]))


def _spread_update(state, pdf):
    """Welford's mean and spread of word lengths, a batch at a time."""
    n, mean, m2 = state
    sizes = [len(w) for t in pdf["text"] if t for w in t.split()]
    if not sizes:
        return state
    k = len(sizes)
    own = sum(sizes) / k
    return _spread_merge([n, mean, m2], [k, own, sum((x - own) ** 2 for x in sizes)])


def _spread_merge(a, b):
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return [n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n]


H.register_metric(H.Metric("word_length_spread", ("text",), lambda: [0, 0.0, 0.0], _spread_update, _spread_merge,
                           lambda s: (s[2] / s[0]) ** 0.5 if s[0] else None))


def _u4_sql():
    each = (f"SELECT lang, length(w) AS k FROM (SELECT lang, unnest({S.words('text')}) AS w FROM documents) x")
    return (f"WITH k AS ({each}) SELECT lang, 'word_length_spread' AS metric, round(stddev_pop(k), 6) AS value FROM k GROUP BY lang "
            "UNION ALL SELECT 'overall', 'word_length_spread', round(stddev_pop(k), 6) FROM k")


@register("u4_metric_plugin", _u4_sql)
def u4_metric_plugin(spark, sf):
    """A metric of the caller, by language and over all."""
    d = TB.table(spark, sf, "documents").select("lang", "text")
    every = H.evaluate(d, ["word_length_spread"]).withColumn("lang", F.lit("overall"))
    return rall(H.evaluate(d, ["word_length_spread"], ["lang"]).unionByName(every))


def _mc_src_sql():
    return ("SELECT g, options, CAST(g % len(options) AS INTEGER) AS answer, CAST(list_position(lens, list_max(lens)) - 1 AS INTEGER) "
            "AS prediction FROM (SELECT item_id // 4 AS g, list(text ORDER BY item_id) AS options, "
            "list(length(text) ORDER BY item_id) AS lens FROM benchmark GROUP BY 1) o")


@register("i28_multiple_choice_accuracy",
          lambda: f"SELECT {R('avg(CAST(prediction = answer AS DOUBLE))')} AS accuracy, count(*) AS n FROM ({_mc_src_sql()}) x")
def i28_multiple_choice_accuracy(spark, sf):
    """Options = the whole texts of four consecutive benchmark items; answer =
    question number modulo their number; prediction = the longest option
    (first on ties)."""
    b = TB.table(spark, sf, "benchmark")
    q = b.groupBy(F.floor(F.col("item_id") / 4).alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("options"))
    lens = F.transform("options", lambda z: F.length(z["text"]))
    pred = (F.array_position(lens, F.array_max(lens)) - 1).cast("int")
    m = q.select(pred.alias("prediction"), F.pmod(F.col("g"), F.size("options")).cast("int").alias("answer"))
    return m.agg(F.round(F.avg((F.col("prediction") == F.col("answer")).cast("double")), 6).alias("accuracy"),
                 F.count(F.lit(1)).alias("n"))


# W3 / W4 -------------------------------------------------------------------
@register("w3_loss_trend",
          lambda: S.with_views(
              "SELECT run, n_points, round(recent, 6) AS recent_mean, round(CASE WHEN n_points > 10 THEN prev END, 6) AS previous_mean, "
              "trend, trend = 'increasing' AND n_points > 50 AS should_stop FROM (SELECT run, n_points, recent, prev, "
              "CASE WHEN n_points <= 10 THEN 'insufficient' WHEN recent > prev * 1.05 THEN 'increasing' WHEN recent < prev * 0.95 "
              "THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT run, count(*) AS n_points, avg(CASE WHEN k <= 10 THEN value END) "
              "AS recent, avg(CASE WHEN k > 10 AND k <= 20 THEN value END) AS prev FROM (SELECT run, value, row_number() OVER "
              "(PARTITION BY run ORDER BY step DESC) AS k FROM metric_log) a WHERE k <= 100 GROUP BY run) b) c", "metric_log"))
def w3_loss_trend(spark, sf):
    t = WN.loss_trend(TB.metric_log(spark, sf))
    return t.select("run", "n_points", F.round("recent_mean", 6).alias("recent_mean"),
                    F.round("previous_mean", 6).alias("previous_mean"), "trend", "should_stop")


@register("w4_early_stopping",
          lambda: S.with_views(
              "WITH s AS (SELECT run, step, value, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING "
              "AND 1 PRECEDING) AS best_before FROM metric_log), i AS (SELECT *, sum(CAST(best_before IS NULL OR value < best_before "
              "AS INTEGER)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM s), "
              "w AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS wait FROM i) "
              "SELECT b.run, b.best_value, b.n_points, st.stop_step FROM (SELECT run, min(value) AS best_value, count(*) AS n_points "
              "FROM metric_log GROUP BY run) b LEFT JOIN (SELECT run, min(step) AS stop_step FROM w WHERE wait >= 3 GROUP BY run) st "
              "USING (run)", "metric_log"))
def w4_early_stopping(spark, sf):
    return WN.early_stopping(TB.metric_log(spark, sf), patience=3).select("run", "best_value", "n_points", "stop_step")


@register("w5_turn_pairing",
          lambda: S.with_views("SELECT conv_id, turn, md5(instruction) AS instruction_md5, md5(response) AS response_md5 FROM sft",
                               "sft"))
def w5_turn_pairing(spark, sf):
    s = TB.sft(spark, sf)
    return s.select("conv_id", "turn", F.md5("instruction").alias("instruction_md5"), F.md5("response").alias("response_md5"))
