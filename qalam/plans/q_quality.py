"""Filter and validation queries (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hooks as H
from ..operators import quality as Q
from ..sources import tables as TB
from ..streaming.jobs import work_dir
from . import sqlref as S
from .catalog import register
from .q_joins import NEXT_PAIR_SQL


@register("e1_length_filter", lambda: "SELECT doc_id FROM documents WHERE length(text) BETWEEN 10 AND 2048")
def e1_length_filter(spark, sf):
    return Q.length_filter(TB.table(spark, sf, "documents"), "text", 10, 2048).select("doc_id")


@register("e2_word_length_filter", lambda: f"SELECT doc_id FROM documents WHERE {S.nwords('text')} BETWEEN 10 AND 512")
def e2_word_length_filter(spark, sf):
    return Q.word_length_filter(TB.table(spark, sf, "documents"), "text").select("doc_id")


def _ar_pairs_sql():
    tr = lambda c: f"translate(lower({c}), {S.q(TB.LATIN)}, {S.q(TB.ARABIC26)}) AS {c}"
    return "SELECT id, " + ", ".join(map(tr, ("prompt", "chosen", "rejected"))) + " FROM pairs"


def _ar_pairs(spark, sf):
    p = TB.pairs(spark, sf)
    return p.select("id", *[F.translate(F.lower(c), TB.LATIN, TB.ARABIC26).alias(c) for c in ("prompt", "chosen", "rejected")])


@register("e3_text_quality_filter",
          lambda: S.with_views("SELECT id, CASE WHEN prompt IS NOT NULL AND NOT " + S.is_quality_text("prompt") +
                               " THEN 'Low quality prompt' WHEN chosen IS NOT NULL AND NOT " + S.is_quality_text("chosen") +
                               " THEN 'Low quality chosen' WHEN rejected IS NOT NULL AND NOT " + S.is_quality_text("rejected") +
                               " THEN 'Low quality rejected' END AS filter_reason FROM ap", "pairs", extra=[("ap", _ar_pairs_sql())]))
def e3_text_quality_filter(spark, sf):
    """Arabised pairs (letters mapped as in ``ar_docs``) through the filter."""
    return Q.text_quality_filter(_ar_pairs(spark, sf)).select("id", "filter_reason")


@register("e4_quality_score",
          lambda: S.with_views(f"SELECT doc_id, {S.rnd(S.quality_score('text'))} AS quality_score FROM ar_docs "
                               f"WHERE {S.quality_score('text')} >= 0.6", "ar_docs"))
def e4_quality_score(spark, sf):
    f = Q.filter_by_quality(TB.ar_docs(spark, sf), "text", 0.6)
    return f.select("doc_id", F.round("quality_score", 6).alias("quality_score"))


RULES = {"text": {"required": True, "min_length": 50, "max_length": 20000, "pattern": "[.!?]"},
         "lang": {"required": True, "pattern": "^(en|fr|de|es|ar)$"},
         "n_chars": {"check": lambda c: c % 2 == 0, "message": "odd number of characters"}, "title": {"required": True}}


def _e5_sql():
    errs = ["CASE WHEN text IS NULL OR text = '' THEN 'text: required' END",
            "CASE WHEN length(text) < 50 THEN 'text: shorter than 50' END",
            "CASE WHEN length(text) > 20000 THEN 'text: longer than 20000' END",
            "CASE WHEN NOT regexp_matches(text, '[.!?]') THEN 'text: pattern mismatch' END",
            "CASE WHEN lang IS NULL OR lang = '' THEN 'lang: required' END",
            "CASE WHEN NOT regexp_matches(lang, '^(en|fr|de|es|ar)$') THEN 'lang: pattern mismatch' END",
            "CASE WHEN NOT n_chars % 2 = 0 THEN 'n_chars: odd number of characters' END",
            "'title: missing required field'"]
    return ("SELECT doc_id, CAST(len(e) AS BIGINT) AS n_errors, len(e) = 0 AS is_valid, array_to_string(e, '|') AS errors FROM "
            "(SELECT doc_id, list_filter([" + ", ".join(errs) + "], lambda z: z IS NOT NULL) AS e FROM documents) x")


@register("e5_rule_validator", _e5_sql)
def e5_rule_validator(spark, sf):
    v = Q.validate_rules(TB.table(spark, sf, "documents"), RULES)
    return v.select("doc_id", F.size("errors").cast("long").alias("n_errors"), "is_valid",
                    F.array_join("errors", "|").alias("errors"))


@register("e6_validation_report",
          lambda: _e6_sql())
def e6_validation_report(spark, sf):
    v = Q.validate_rules(TB.table(spark, sf, "documents"), RULES)
    return Q.validation_report(v).select("section", "key", F.col("value").cast("long").alias("value"))


def _e6_sql():
    base = _e5_sql().replace("array_to_string(e, '|') AS errors", "e AS errs")
    return (f"WITH v AS ({base}) SELECT 'summary' AS section, 'total' AS key, count(*) AS value FROM v UNION ALL "
            "SELECT 'summary', 'valid', count_if(is_valid) FROM v UNION ALL SELECT 'summary', 'invalid', count_if(NOT is_valid) FROM v "
            "UNION ALL SELECT * FROM (SELECT 'top_errors', key, count(*) AS value FROM (SELECT unnest(list_distinct(errs)) AS key FROM v) e "
            "GROUP BY key ORDER BY value DESC, key LIMIT 10)")


def _e7_sql():
    stats = ("SELECT count(*) AS size, avg(n) AS avg_words, min(n) AS min_words, max(n) AS max_words, avg(r) AS avg_arabic_ratio "
             f"FROM (SELECT CAST({S.nwords('t')} AS BIGINT) AS n, {S.arabic_ratio_block_alpha('t')} AS r FROM "
             "(SELECT coalesce(text, '') AS t FROM ar_docs) y) z")
    return S.with_views(
        f"SELECT size, {S.rnd('avg_words')} AS avg_words, min_words, max_words, {S.rnd('avg_arabic_ratio')} AS avg_arabic_ratio, "
        "array_to_string(list_filter([CASE WHEN size < 100 THEN 'too_small' END, 'missing_column:label'], lambda z: z IS NOT NULL), "
        "'|') AS issues, array_to_string(list_filter([CASE WHEN size > 1000000 THEN 'very_large' END, CASE WHEN avg_words < 10 "
        "THEN 'short_texts' END, CASE WHEN avg_words > 1000 THEN 'long_texts' END, CASE WHEN avg_arabic_ratio < 0.5 THEN "
        f"'low_arabic_content' END], lambda z: z IS NOT NULL), '|') AS warnings, false AS passed FROM ({stats}) a", "ar_docs")


@register("e7_dataset_gate", _e7_sql)
def e7_dataset_gate(spark, sf):
    g = Q.dataset_gate(TB.ar_docs(spark, sf), "text", ("doc_id", "text", "label"))
    return g.select("size", F.round("avg_words", 6).alias("avg_words"), "min_words", "max_words",
                    F.round("avg_arabic_ratio", 6).alias("avg_arabic_ratio"), F.array_join("issues", "|").alias("issues"),
                    F.array_join("warnings", "|").alias("warnings"), "passed")


def _e9_sql(method, table, cols):
    blank = lambda c: f"coalesce({S.strip(f'CAST({c} AS VARCHAR)')}, '') = ''"
    texts = [c for c in cols if c != "label"]
    missing = " OR ".join(f"{c} IS NULL" for c in cols)
    empty = (" AND " if method == "sft" else " OR ").join(map(blank, texts))
    same = ", count_if(chosen = rejected) AS chosen_equals_rejected" if method == "dpo" else ""
    return S.with_views(
        f"SELECT *, missing_fields = 0 AND empty_texts = 0 AS passed FROM (SELECT count(*) AS rows, count_if({missing}) AS missing_fields, "
        f"count_if(NOT ({missing}) AND ({empty})) AS empty_texts, "
        + ", ".join(f"count_if({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS empty_{c}" for c in cols) + f"{same} FROM {table}) x", table)


@register("e9_method_validators", lambda: _e9_sql("dpo", "pairs", ["prompt", "chosen", "rejected"]))
def e9_method_validators(spark, sf):
    return Q.method_checks(TB.pairs(spark, sf), "dpo")


@register("e9_sft_validator", lambda: _e9_sql("sft", "sft", ["instruction", "response"]))
def e9_sft_validator(spark, sf):
    return Q.method_checks(TB.sft(spark, sf), "sft")


@register("e9_kto_validator", lambda: _e9_sql("kto", "kto", ["prompt", "completion", "label"]))
def e9_kto_validator(spark, sf):
    return Q.method_checks(TB.kto(spark, sf), "kto")


@register("e10_missing_field_skip",
          lambda: S.with_views("SELECT conv_id, turn FROM sft WHERE instruction IS NOT NULL AND response IS NOT NULL", "sft"))
def e10_missing_field_skip(spark, sf):
    return Q.drop_missing(TB.sft(spark, sf), ["instruction", "response"]).select("conv_id", "turn")


@register("e11_sft_validity",
          lambda: S.with_views(f"SELECT conv_id, turn, length({S.strip('instruction')}) BETWEEN 1 AND 4096 AND "
                               f"length({S.strip('response')}) BETWEEN 1 AND 4096 AS valid FROM sft", "sft"))
def e11_sft_validity(spark, sf):
    return TB.sft(spark, sf).select("conv_id", "turn", Q.sft_valid().alias("valid"))


@register("e12_preference_validity",
          lambda: S.with_views(f"SELECT id, v AS valid, v AND {S.has_arabic('prompt')} AND {S.has_arabic('chosen')} AND "
                               f"{S.has_arabic('rejected')} AS valid_arabic FROM (SELECT *, length(prompt) BETWEEN 1 AND 1024 AND "
                               "length(chosen) BETWEEN 10 AND 4096 AND length(rejected) BETWEEN 10 AND 4096 AND "
                               f"{S.sim('chosen', 'rejected')} < 0.9 AS v FROM ap) x", "pairs", extra=[("ap", _ar_pairs_sql())]))
def e12_preference_validity(spark, sf):
    return _ar_pairs(spark, sf).select("id", Q.preference_valid().alias("valid"),
                                       Q.preference_valid(require_arabic=True).alias("valid_arabic"))


@register("e13_dpo_filters",
          lambda: S.with_views(
              f"SELECT id, CASE WHEN NOT length({S.strip('prompt')}) BETWEEN 1 AND 1024 THEN 'prompt_length' WHEN NOT "
              f"(length({S.strip('chosen')}) BETWEEN 10 AND 4096 AND length({S.strip('rejected')}) BETWEEN 10 AND 4096) THEN 'length' "
              f"WHEN {S.quality('chosen')} - {S.quality('rejected')} < 0.1 THEN 'quality_diff' WHEN {S.sim('chosen', 'rejected')} > 0.9 "
              f"THEN 'similarity' WHEN {S.dpo_strength('chosen', 'rejected')} < 0.5 THEN 'strength' WHEN "
              "greatest(length(chosen), length(rejected)) / CAST(greatest(least(length(chosen), length(rejected)), 1) AS DOUBLE) > 3.0 "
              "THEN 'length_ratio' END AS filter_reason FROM pairs", "pairs"))
def e13_dpo_filters(spark, sf):
    return Q.dpo_filter(TB.pairs(spark, sf)).select("id", "filter_reason")


@register("e14_ipo_filters",
          lambda: S.with_views(
              "SELECT id, CASE WHEN greatest(length(chosen), length(rejected)) / CAST(greatest(least(length(chosen), length(rejected)), 1) "
              "AS DOUBLE) > 3.0 THEN 'length_ratio' WHEN abs(length(chosen) - length(rejected)) < 20 THEN 'length_difference' WHEN " +
              S.length_bias("chosen", "rejected") + " > 0.5 THEN 'length_bias' WHEN " +
              S.length_normalized_quality(S.quality("chosen"), "length(chosen)") + " - " +
              S.length_normalized_quality(S.quality("rejected"), "length(rejected)") +
              " < 0 THEN 'normalized_quality' END AS filter_reason FROM pairs", "pairs"))
def e14_ipo_filters(spark, sf):
    return Q.ipo_filter(TB.pairs(spark, sf)).select("id", "filter_reason")


@register("e15_kto_filters",
          lambda: S.with_views(
              f"SELECT id, CASE WHEN label IS NULL THEN 'label' WHEN NOT coalesce(length({S.strip('prompt')}) >= 1 AND length(prompt) <= 1024, "
              f"false) THEN 'prompt_length' WHEN NOT (length({S.strip('completion')}) >= 10 AND length(completion) <= 4096) THEN 'length' "
              f"WHEN {S.quality('completion')} < 0.2 THEN 'quality' WHEN NOT (CASE WHEN label = 1 THEN pow({S.quality('completion')}, 0.88) "
              f"ELSE -2.25 * pow(1.0 - {S.quality('completion')}, 0.88) END) BETWEEN -2.25 AND 1.0 THEN 'utility' END AS filter_reason "
              "FROM kto", "kto"))
def e15_kto_filters(spark, sf):
    return Q.kto_filter(TB.kto(spark, sf)).select("id", "filter_reason")


@register("e16_cpo_validity",
          lambda: S.with_views(f"SELECT id, length({S.strip('prompt')}) >= 1 AND length({S.strip('chosen')}) >= 1 AND len(n) BETWEEN 2 AND 8 "
                               f"AND len(list_filter(n, lambda z: length({S.strip('z')}) < 1 OR {S.sim('chosen', 'z')} > 0.9)) = 0 AS valid "
                               "FROM (SELECT *, list_filter([rejected, other, other_prompt], lambda z: length(z) > 0) AS n FROM nextp) x",
                               "pairs", extra=[("nextp", NEXT_PAIR_SQL)]))
def e16_cpo_validity(spark, sf):
    p = TB.with_next(TB.pairs(spark, sf)).withColumn("negatives", F.filter(F.array("rejected", "other", "other_prompt"),
                                                                           lambda z: F.length(z) > 0))
    return p.select("id", Q.cpo_valid("negatives").alias("valid"))


@register("e17_length_ratio_balance",
          lambda: S.with_views("SELECT id FROM pairs WHERE greatest(length(chosen), length(rejected)) / "
                               "CAST(greatest(least(length(chosen), length(rejected)), 1) AS DOUBLE) <= 2.0", "pairs"))
def e17_length_ratio_balance(spark, sf):
    return Q.length_ratio_filter(TB.pairs(spark, sf), 2.0).select("id")


STAGES_SQL = [("has_text", "coalesce(length(text), 0) > 0"), ("min_words", f"{S.nwords('text')} >= 20"),
              ("max_chars", "length(text) <= 10000"), ("arabic", S.has_arabic("text"))]


def _e18_sql():
    reason = "CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN '{n}'" for n, c in STAGES_SQL) + " END"
    order = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(STAGES_SQL)) + ") v(idx, stage)"
    body = ("SELECT o.idx, o.stage, t.total - coalesce(sum(coalesce(c.c, 0)) OVER (ORDER BY o.idx ROWS BETWEEN UNBOUNDED PRECEDING "
            "AND 1 PRECEDING), 0) AS processed, coalesce(c.c, 0) AS filtered, round(CASE WHEN t.total - coalesce(sum(coalesce(c.c, 0)) "
            "OVER (ORDER BY o.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN coalesce(c.c, 0) / (t.total - "
            "coalesce(sum(coalesce(c.c, 0)) OVER (ORDER BY o.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) ELSE 0.0 END, 6) "
            f"AS filter_rate FROM ({order}) o LEFT JOIN (SELECT {reason} AS stage, count(*) AS c FROM ar_docs GROUP BY 1) c USING (stage) "
            "CROSS JOIN (SELECT count(*) AS total FROM ar_docs) t")
    return S.with_views(body, "ar_docs")


@register("e18_stage_pipeline", _e18_sql)
def e18_stage_pipeline(spark, sf):
    t = F.col("text")
    stages = [("has_text", F.coalesce(F.length(t), F.lit(0)) > 0), ("min_words", T.word_count(t) >= 20),
              ("max_chars", F.length(t) <= 10000), ("arabic", T.has_arabic(t))]
    _, s = H.run_stages(TB.ar_docs(spark, sf).select("doc_id", "text"), stages, work_dir(spark, "stages"))
    return s.select("idx", "stage", F.col("processed").cast("long").alias("processed"),
                    F.col("filtered").cast("long").alias("filtered"), F.round("filter_rate", 6).alias("filter_rate"))


@register("e19_sample_format_issues",
          lambda: S.with_views("SELECT 'sft' AS kind, CAST(conv_id AS VARCHAR) AS key, 'Empty or missing instruction' AS issue FROM sft "
                               f"WHERE coalesce({S.strip('instruction')}, '') = '' UNION ALL "
                               "SELECT 'sft', CAST(conv_id AS VARCHAR), 'Empty or missing output' FROM sft "
                               f"WHERE coalesce({S.strip('response')}, '') = '' UNION ALL "
                               "SELECT 'text', CAST(doc_id AS VARCHAR), CASE WHEN "
                               f"coalesce({S.strip('text')}, '') = '' THEN 'Empty or missing text' ELSE 'Text too short' END FROM ar_docs "
                               f"WHERE coalesce({S.strip('text')}, '') = '' OR length(text) < 10", "sft", "ar_docs"))
def e19_sample_format_issues(spark, sf):
    sft = TB.sft(spark, sf).withColumnRenamed("response", "output")
    a = Q.sample_format_issues(sft, "conv_id", "instruction").select(F.lit("sft").alias("kind"), F.col("conv_id").alias("key"), "issue")
    b = Q.sample_format_issues(TB.ar_docs(spark, sf), "doc_id", "text").select(F.lit("text").alias("kind"), F.col("doc_id").alias("key"), "issue")
    return a.unionByName(b).withColumn("key", F.col("key").cast("string"))
