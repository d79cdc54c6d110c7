"""Negative mining and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import negatives as N
from ..operators import joins as J
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register


def _f4_sql():
    s = (f"SELECT id, prompt, {S.quality('chosen')} AS q, chosen, rejected, {S.quality('rejected')} AS qr FROM pairs")
    c = ("SELECT a.id, b.id * 2 AS ord, b.id AS other_id, 'chosen' AS kind, b.chosen AS negative FROM s a JOIN s b "
         "ON b.prompt <> a.prompt AND abs(a.q - b.q) < 0.2 AND b.q < a.q UNION ALL "
         "SELECT a.id, b.id * 2 + 1, b.id, 'negative', b.rejected FROM s a JOIN s b ON b.prompt <> a.prompt AND b.qr > a.q * 0.8")
    body = ("SELECT id, rank, other_id, kind, md5(negative) AS negative_md5 FROM (SELECT *, row_number() OVER "
            "(PARTITION BY id ORDER BY ord) AS rank FROM c) x WHERE rank <= 3")
    return S.with_views(body, "pairs", extra=[("s", s), ("c", c)])


@register("f4_hard_negatives", _f4_sql)
def f4_hard_negatives(spark, sf):
    h = N.hard_negatives(TB.pairs(spark, sf))
    return h.select("id", F.col("rank").cast("long").alias("rank"), "other_id", "kind", F.md5("negative").alias("negative_md5"))


@register("f5_group_negatives",
          lambda: S.with_views("SELECT a.g, a.id, b.id AS oid, md5(b.chosen) AS negative_md5 FROM "
                               "(SELECT id, (id - 1) // 8 AS g FROM pairs) a JOIN (SELECT id, chosen, (id - 1) // 8 AS g FROM pairs) b "
                               "ON a.g = b.g AND a.id <> b.id", "pairs"))
def f5_group_negatives(spark, sf):
    """Contrastive groups of 8 consecutive samples (G8), others' chosen as negatives."""
    p = TB.pairs(spark, sf).withColumn("g", F.floor((F.col("id") - 1) / 8).cast("long"))
    g = N.group_negatives(p, "g", "id", "chosen")
    return g.select("g", "id", "oid", F.md5("negative").alias("negative_md5"))


def _f6_sql():
    t, w, n = "chosen", S.words("chosen"), S.nwords("chosen")
    key = "concat(CAST(id AS VARCHAR), '|', CAST(i - 1 AS VARCHAR))"
    half = f"array_to_string(w[1:greatest(CAST(floor(n / 2) AS BIGINT), 1)], ' ')"
    shuffled = (f"array_to_string(list_transform(list_sort(list_transform(w, lambda x, i: struct_pack(r := {S.u(42, key)}, x := x))), "
                "lambda s: s.x), ' ')")
    negated = (f"CASE WHEN NOT contains({t}, 'لا') THEN 'لا ' || {t} WHEN NOT contains({t}, 'ليس') THEN 'ليس ' || {t} "
               f"WHEN NOT contains({t}, 'غير') THEN 'غير ' || {t} END")
    body = (f"SELECT id, list_transform(list_filter([CASE WHEN n > 3 THEN {half} END, CASE WHEN n > 2 THEN {shuffled} END, {negated}, "
            "'لا أعرف الإجابة على هذا السؤال.'], lambda x: x IS NOT NULL)[1:3], lambda x: md5(x)) AS negatives_md5 "
            f"FROM (SELECT id, chosen, {w} AS w, {n} AS n FROM pairs) y")
    return S.with_views(body, "pairs")


@register("f6_synthetic_negatives", _f6_sql)
def f6_synthetic_negatives(spark, sf):
    p = TB.pairs(spark, sf)
    return p.select("id", F.transform(N.synthetic_negatives("chosen", "id"), lambda x: F.md5(x)).alias("negatives_md5"))


NEXT_PAIR_SQL = ("SELECT p.*, o.rejected AS other, o.prompt AS other_prompt FROM pairs p JOIN pairs o ON o.id = p.id % (SELECT count(*) FROM pairs) + 1")


def _f7_sql():
    cand = ("SELECT id, k, neg, q, qn FROM (SELECT id, " + S.quality("chosen") + " AS q, unnest([rejected, other_prompt, "
            "other]) AS neg, unnest([1, 2, 3]) AS k, chosen FROM nextp) z, LATERAL (SELECT " +
            S.quality("neg") + " AS qn) y")
    score = ("0.4 * (1.0 - abs(q - qn)) + 0.3 * (1.0 - " + S.sim("neg", "chosen_") + ") + 0.3 * least(1.0 / (abs(q - qn) + 0.1) / 10.0, 1.0)")
    body = (f"SELECT id, k, rank FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY {score} DESC, k) AS rank "
            "FROM (SELECT c.*, p.chosen AS chosen_ FROM cand c JOIN pairs p USING (id)) w) x WHERE rank <= 2")
    return S.with_views(body, "pairs", extra=[("nextp", NEXT_PAIR_SQL), ("cand", cand)])


@register("f7_best_negatives", _f7_sql)
def f7_best_negatives(spark, sf):
    p = TB.with_next(TB.pairs(spark, sf))
    cands = p.select("id", "chosen", F.posexplode(F.array("rejected", "other_prompt", "other")).alias("pos", "neg")).withColumn("k", F.col("pos") + 1)
    b = J.best_negatives(cands, "id", "chosen", "neg", "k", 2)
    return b.select("id", F.col("k").cast("int").alias("k"), F.col("rank").cast("long").alias("rank"))


@register("f8_adaptive_negatives",
          lambda: S.with_views(
              "SELECT id, len(list_filter(list_transform([rejected, other_prompt], lambda z: " + S.quality("z") +
              "), lambda qn: q - qn >= 0.1 + 0.4 * (1 - 0.5) AND q - qn <= 0.8 - 0.3 * 0.5)) AS n_selected "
              "FROM (SELECT *, " + S.quality("chosen") + " AS q FROM nextp) x", "pairs", extra=[("nextp", NEXT_PAIR_SQL)]))
def f8_adaptive_negatives(spark, sf):
    """Progress 0.5: keep negatives whose quality lies below the chosen one's by a
    gap in the band [0.1 + 0.4 (1 - p), 0.8 - 0.3 p]."""
    p = TB.with_next(TB.pairs(spark, sf))
    return p.select("id", F.size(J.adaptive_negatives(T.quality("chosen"), F.array("rejected", "other_prompt"), 0.5)).alias("n_selected"))


@register("f9_negative_diversity",
          lambda: S.with_views(
              "SELECT a.rid AS id, round(avg(" + S.sim("a.ni", "b.nj") + "), 6) AS mean_similarity, round(1 - avg(" +
              S.sim("a.ni", "b.nj") + "), 6) AS diversity FROM (SELECT id AS rid, unnest([rejected, other_prompt, other]) AS ni, "
              "unnest([0, 1, 2]) AS i FROM nextp) a JOIN (SELECT id AS rid, unnest([rejected, other_prompt, other]) AS nj, "
              "unnest([0, 1, 2]) AS j FROM nextp) b ON a.rid = b.rid AND a.i < b.j GROUP BY a.rid", "pairs", extra=[("nextp", NEXT_PAIR_SQL)]))
def f9_negative_diversity(spark, sf):
    p = TB.with_next(TB.pairs(spark, sf)).select("id", F.array("rejected", "other_prompt", "other").alias("negs"))
    d = N.negative_diversity(p, "id", "negs")
    return d.select("id", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("diversity", 6).alias("diversity"))


@register("f9_negative_hardness",
          lambda: S.with_views(
              "SELECT id, round(least(1.0 / (list_avg(list_transform([rejected, other_prompt, other], lambda z: q - " + S.quality("z") +
              ")) + 0.1) / 10.0, 1.0), 6) AS hardness FROM (SELECT *, " + S.quality("chosen") + " AS q FROM nextp) x", "pairs",
              extra=[("nextp", NEXT_PAIR_SQL)]))
def f9_negative_hardness(spark, sf):
    p = TB.with_next(TB.pairs(spark, sf)).select("id", "chosen", F.array("rejected", "other_prompt", "other").alias("negs"))
    return p.select("id", F.round(N.negative_hardness("chosen", "negs"), 6).alias("hardness"))


# F10-F18 -------------------------------------------------------------------
def _models_spark(spark, sf):
    r = TB.runs(spark, sf)
    return r.select("method", "dataset", F.col("checkpoint_path").alias("path"),
                    F.concat(F.lit("qwen-"), F.col("method")).alias("model_name"), "samples_trained")


@register("f10_results_models_join",
          lambda: S.with_views("SELECT r.method, r.dataset, r.final_loss, m.path FROM runs r LEFT JOIN "
                               "(SELECT method, dataset, arg_max(checkpoint_path, samples_trained) AS path FROM runs "
                               "WHERE status = 'completed' GROUP BY 1, 2) m USING (method, dataset)", "runs"))
def f10_results_models_join(spark, sf):
    r = TB.runs(spark, sf)
    models = _models_spark(spark, sf).join(r.filter(F.col("status") == "completed").select("method", "dataset"),
                                           ["method", "dataset"], "left_semi")
    return J.results_with_models(r.select("method", "dataset", "final_loss"), models, "samples_trained") \
        .select("method", "dataset", "final_loss", "path")


REQUIRED = ["config.json", "model.safetensors", "tokenizer.json"]


@register("f11_missing_artefacts",
          lambda: S.with_views("SELECT r.method, r.dataset, f.file FROM runs r CROSS JOIN (SELECT unnest(" + S.lst(REQUIRED) +
                               ") AS file) f WHERE NOT (r.status = 'completed' AND f.file <> 'model.safetensors') "
                               "AND NOT (r.status = 'completed' AND r.samples_trained % 2 = 0)", "runs"))
def f11_missing_artefacts(spark, sf):
    """Expected = runs x required files; present = config and tokenizer for
    completed runs, weights for completed runs with an even sample count."""
    r = TB.runs(spark, sf)
    done = F.col("status") == "completed"
    present = r.select("method", "dataset", F.explode(F.when(done & (F.col("samples_trained") % 2 == 0),
                                                              F.array(*[F.lit(x) for x in REQUIRED]))
                                                       .when(done, F.array(F.lit("config.json"), F.lit("tokenizer.json")))
                                                       .otherwise(F.array().cast("array<string>"))).alias("file"))
    return J.missing_artefacts(r.select("method", "dataset"), REQUIRED, present)


@register("f12_missing_rows",
          lambda: "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def f12_missing_rows(spark, sf):
    """Documents without a label row: ``exceptAll`` on the key (the schema
    variant, ``joins.column_diff``, compares column sets)."""
    d = TB.table(spark, sf, "documents").select("doc_id")
    return d.exceptAll(TB.table(spark, sf, "labels").select("doc_id"))


#: Every two of the run datasets.
RUN_PAIRS = [("arabic_sft", "arabic_preference"), ("arabic_sft", "arabic_eval"), ("arabic_preference", "arabic_eval")]


def _f13_sql():
    long = ("(SELECT unnest(['avg_loss', 'avg_samples', 'n_runs']) AS metric, unnest([avg(final_loss), avg(samples_trained), count(*)]) "
            "AS v FROM runs WHERE dataset = '{}')")
    one = ("SELECT '{0}' AS dataset_1, '{1}' AS dataset_2, a.metric, round(a.v, 6) AS model_1, round(b.v, 6) AS model_2, round(a.v - b.v, 6) "
           "AS difference, round((a.v - b.v) / greatest(abs(b.v), 1e-8) * 100, 6) AS relative_improvement, CASE WHEN a.v > b.v THEN "
           "'model_1' ELSE 'model_2' END AS better_model FROM {2} a JOIN {3} b USING (metric)")
    return S.with_views(" UNION ALL ".join(one.format(x, y, long.format(x), long.format(y)) for x, y in RUN_PAIRS), "runs")


def _each_pair(of):
    """The rows of ``of(dataset, dataset)`` for every two datasets."""
    parts = [of(x, y).select(F.lit(x).alias("dataset_1"), F.lit(y).alias("dataset_2"), "*") for x, y in RUN_PAIRS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("f13_metric_comparison", _f13_sql)
def f13_metric_comparison(spark, sf):
    r = TB.runs(spark, sf)

    def long_metrics(ds):
        a = r.filter(F.col("dataset") == ds).agg(F.avg("final_loss").alias("avg_loss"),
                                                 F.avg("samples_trained").alias("avg_samples"),
                                                 F.count(F.lit(1)).cast("double").alias("n_runs"))
        return a.unpivot([], ["avg_loss", "avg_samples", "n_runs"], "metric", "value")
    c = _each_pair(lambda x, y: J.compare_metrics(long_metrics(x), long_metrics(y)))
    return c.select("dataset_1", "dataset_2", "metric", *[F.round(x, 6).alias(x) for x in (
        "model_1", "model_2", "difference", "relative_improvement")], "better_model")


def _f14_sql():
    one = ("SELECT '{0}' AS dataset_1, '{1}' AS dataset_2, coalesce(a.method, b.method) AS method, CASE WHEN a.method IS NULL THEN 'only_right' "
           "WHEN b.method IS NULL THEN 'only_left' ELSE 'common' END AS side, round(abs(a.final_loss - b.final_loss), 6) AS abs_diff, "
           "coalesce(abs(a.final_loss - b.final_loss) <= 0.5, false) AS within_tolerance FROM "
           "(SELECT method, final_loss FROM runs WHERE dataset = '{0}' AND status = 'completed') a FULL OUTER JOIN "
           "(SELECT method, final_loss FROM runs WHERE dataset = '{1}') b USING (method)")
    return S.with_views(" UNION ALL ".join(one.format(x, y) for x, y in RUN_PAIRS), "runs")


@register("f14_keyed_diff", _f14_sql)
def f14_keyed_diff(spark, sf):
    """Completed runs of one dataset against all runs of another, by method."""
    r = TB.runs(spark, sf)
    of = lambda ds: r.filter(F.col("dataset") == ds)
    d = _each_pair(lambda x, y: J.keyed_diff(of(x).filter(F.col("status") == "completed").select("method", "final_loss"),
                                             of(y).select("method", "final_loss"), "method", "final_loss", 0.5))
    return d.select("dataset_1", "dataset_2", "method", "side", F.round("abs_diff", 6).alias("abs_diff"), "within_tolerance")


@register("f15_lexicon_match",
          lambda: S.with_views("SELECT a.doc_id, l.dialect, count(*) AS hits FROM (SELECT doc_id, " + S.normalize_dialect("lower(text)") +
                               " AS n FROM ar_docs) a JOIN lex l ON contains(a.n, l.term) GROUP BY 1, 2", "ar_docs",
                               extra=[("lex", J.lexicon_values_sql())]))
def f15_lexicon_match(spark, sf):
    from ..operators.dialect import T as _T  # noqa: F401
    a = TB.ar_docs(spark, sf).select("doc_id", T.normalize_dialect(F.lower(F.col("text"))).alias("n"))
    return J.lexicon_match(a, "n").groupBy("doc_id", "dialect").agg(F.count(F.lit(1)).alias("hits"))


@register("f16_prediction_pairing",
          lambda: S.with_views("SELECT s.conv_id, s.turn, CAST(" + S.nwords("s.response") + " AS BIGINT) AS pred_words, CAST(" +
                               S.nwords("c.text") + " AS BIGINT) AS ref_words FROM sft s JOIN conversations c ON c.conv_id = s.conv_id "
                               "AND c.turn = s.turn + 1", "sft"))
def f16_prediction_pairing(spark, sf):
    s = TB.sft(spark, sf)
    c = TB.table(spark, sf, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    j = J.pair_predictions(s, c, ["conv_id", "turn"])
    return j.select("conv_id", "turn", T.word_count("response").cast("long").alias("pred_words"),
                    T.word_count("ref").cast("long").alias("ref_words"))


@register("f17_concatenate",
          lambda: S.with_views("SELECT 'sft' AS source_dataset, md5(instruction) AS text_md5 FROM sft UNION ALL "
                               "SELECT 'pairs', md5(prompt) FROM pairs", "sft", "pairs"))
def f17_concatenate(spark, sf):
    a = TB.sft(spark, sf).select(F.lit("sft").alias("source_dataset"), F.col("instruction").alias("text"))
    b = TB.pairs(spark, sf).select(F.lit("pairs").alias("source_dataset"), F.col("prompt").alias("text"))
    return J.concatenate([a, b]).select("source_dataset", F.md5("text").alias("text_md5"))


@register("f18_common_metrics",
          lambda: S.with_views("SELECT event_type FROM events INTERSECT SELECT method FROM runs", "runs"))
def f18_common_metrics(spark, sf):
    """Metric names of the event table that the run log has too."""
    e = TB.table(spark, sf, "events")
    return e.select("event_type").intersect(TB.runs(spark, sf).select("method"))


@register("a7_combine_sources",
          lambda: S.with_views("SELECT 'conversations' AS source_dataset, conv_id AS id, md5(instruction) AS prompt_md5 FROM sft "
                               "UNION ALL SELECT 'labels', id, md5(prompt) FROM kto", "sft", "kto"))
def a7_combine_sources(spark, sf):
    from ..sources import io as IO
    a = TB.sft(spark, sf).select(F.col("conv_id").alias("id"), F.col("instruction").alias("prompt"))
    b = TB.kto(spark, sf).select("id", "prompt", "label")
    c = IO.combine({"conversations": a, "labels": b})
    return c.select("source_dataset", "id", F.md5("prompt").alias("prompt_md5"))
