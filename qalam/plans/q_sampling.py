"""Sampling / splitting / ordering queries (G*, A8) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as G
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register


def _docs(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")


U = S.u(42, "doc_id")


# G1 / G2 / G3 --------------------------------------------------------------
@register("g1_seeded_shuffle",
          lambda: f"SELECT doc_id, row_number() OVER (ORDER BY {U}, doc_id) AS shuffle_rank FROM documents")
def g1_seeded_shuffle(spark, sf):
    return G.shuffle(_docs(spark, sf).select("doc_id"), "doc_id")


def _g2_sql():
    return (f"SELECT doc_id, CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - held + (held - n_test) "
            "THEN 'validation' ELSE 'test' END AS split FROM ("
            f"SELECT doc_id, row_number() OVER (ORDER BY {U}, doc_id) AS rn, count(*) OVER () AS n FROM documents) x, "
            "LATERAL (SELECT CAST(ceil(CAST(0.1 + 0.1 AS DOUBLE) * n) AS BIGINT) AS held) h, "
            "LATERAL (SELECT CAST(ceil((1 - 0.1 / (0.1 + 0.1)) * held) AS BIGINT) AS n_test) t")


@register("g2_exact_split", _g2_sql)
def g2_exact_split(spark, sf):
    return G.split(_docs(spark, sf).select("doc_id"), "doc_id", 0.8, 0.1, 0.1).select("doc_id", "split")


@register("g3_random_sample",
          lambda: f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {U}, doc_id) AS rn FROM documents) x "
                  "WHERE rn <= 100")
def g3_random_sample(spark, sf):
    return G.random_sample(_docs(spark, sf).select("doc_id"), 100, "doc_id")


# G4 ------------------------------------------------------------------------
def _g4_sql():
    return ("WITH c AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), "
            "k AS (SELECT lang, c, greatest(1, floor(100 * (c / sum(c) OVER ()))) AS k FROM c), "
            "q AS (SELECT lang, least(c, CASE WHEN sum(k) OVER () > 100 THEN greatest(1, floor(k * (100 / sum(k) OVER ()))) "
            "ELSE k END) AS quota FROM k) "
            f"SELECT doc_id, lang FROM (SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY {U}, d.doc_id) "
            "AS rn, q.quota FROM documents d JOIN q USING (lang)) x WHERE rn <= quota")


@register("g4_stratified_sample", _g4_sql)
def g4_stratified_sample(spark, sf):
    return G.stratified_sample(_docs(spark, sf).select("doc_id", "lang"), 100, "lang", "doc_id").select("doc_id", "lang")


# G5 ------------------------------------------------------------------------
@register("g5_systematic_sample",
          lambda: "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n "
                  "FROM events) x WHERE (rn - 1) % floor(n / least(1000, n)) = 0 AND (rn - 1) / floor(n / least(1000, n)) "
                  "< least(1000, n)")
def g5_systematic_sample(spark, sf):
    e = TB.table(spark, sf, "events").select("event_id")
    return G.systematic_sample(e, "event_id", 1000).select("event_id")


# G6 ------------------------------------------------------------------------
MIX = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}


def _g6_sql():
    parts = []
    tot = sum(MIX.values())
    for lang, r in MIX.items():
        parts.append(f"SELECT doc_id, '{lang}' AS source_dataset FROM (SELECT doc_id, row_number() OVER (ORDER BY {U}, doc_id) "
                     f"AS rn FROM documents WHERE lang = '{lang}') x, m WHERE rn <= floor({r / tot} * min_len * {len(MIX)})")
    u = S.u(42, "source_dataset || '|' || CAST(doc_id AS VARCHAR)")
    return ("WITH m AS (SELECT min(n) AS min_len FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) c), "
            f"mixed AS ({' UNION ALL '.join(parts)}) SELECT *, row_number() OVER (ORDER BY {u}, source_dataset, doc_id) AS shuffle_rank "
            "FROM mixed")


@register("g6_dataset_mix", _g6_sql)
def g6_dataset_mix(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang")
    sets = {lang: d.filter(F.col("lang") == lang).select("doc_id") for lang in MIX}
    return G.mix(sets, MIX, "doc_id").select("doc_id", "source_dataset", "shuffle_rank")


# G7 ------------------------------------------------------------------------
def _g7_sql():
    n = S.nwords("text")
    b = f"CASE WHEN {n} <= 100 THEN 'short' WHEN {n} <= 300 THEN 'medium' ELSE 'long' END"
    return ("WITH b AS (SELECT doc_id, " + b + " AS length_bucket FROM documents), "
            "t AS (SELECT * FROM (VALUES ('short', 0.3), ('medium', 0.5), ('long', 0.2)) v(length_bucket, ratio)), "
            "q AS (SELECT length_bucket, floor((SELECT count(*) FROM documents) * ratio) AS quota FROM t) "
            f"SELECT doc_id, length_bucket FROM (SELECT b.*, row_number() OVER (PARTITION BY length_bucket ORDER BY {U}, doc_id) "
            "AS rn, quota FROM b JOIN q USING (length_bucket)) x WHERE rn <= quota")


@register("g7_length_balance", _g7_sql)
def g7_length_balance(spark, sf):
    return G.balance_by_length(_docs(spark, sf).select("doc_id", "text"), "text", "doc_id").select("doc_id", "length_bucket")


# G8 / G9 -------------------------------------------------------------------
@register("g8_fixed_groups",
          lambda: "SELECT doc_id, CAST(floor((rn - 1) / 64) AS BIGINT) AS group_id, CAST((rn - 1) % 64 AS BIGINT) AS position, "
                  "CAST(least(64, n - floor((rn - 1) / 64) * 64) AS BIGINT) AS group_size FROM "
                  "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) x")
def g8_fixed_groups(spark, sf):
    g = G.fixed_groups(_docs(spark, sf).select("doc_id"), "doc_id", 64)
    return g.select("doc_id", F.col("group_id").cast("long").alias("group_id"), F.col("position").cast("long").alias("position"),
                    F.col("group_size").cast("long").alias("group_size"))


@register("g9_label_balance",
          lambda: S.with_views(
              "WITH c AS (SELECT label, count(*) AS c FROM kto GROUP BY label), q AS (SELECT label, floor(min(c) OVER () * 1.1) "
              f"AS quota FROM c) SELECT id, label FROM (SELECT k.id, k.label, row_number() OVER (PARTITION BY k.label ORDER BY "
              f"{S.u(42, 'k.id')}, k.id) AS rn, q.quota FROM kto k JOIN q USING (label)) x WHERE rn <= quota", "kto"))
def g9_label_balance(spark, sf):
    k = TB.kto(spark, sf).select("id", "label")
    return G.balance_labels(k, "label", "id", 0.1).select("id", "label")


# G10 / G11 -----------------------------------------------------------------
def _eff_sql():
    t = "CAST(regexp_extract(training_time, '([0-9.]+)', 1) AS DOUBLE)"
    return (f"SELECT method, dataset, samples_trained * epochs / greatest({t}, 0.001) AS efficiency, {t} AS seconds, "
            "final_loss FROM runs WHERE status = 'completed'")


@register("g10_method_rankings",
          lambda: S.with_views("SELECT method, dataset, row_number() OVER (ORDER BY efficiency DESC, seconds ASC, final_loss ASC, method, "
                               "dataset) AS rank FROM eff", "runs", extra=[("eff", _eff_sql())]))
def g10_method_rankings(spark, sf):
    from ..operators.metrics import efficiency_table
    from pyspark.sql import Window as W
    e = efficiency_table(TB.runs(spark, sf))
    # a run log has a row per method and dataset; ties go by their names
    w = W.orderBy(F.col("efficiency").desc(), F.col("seconds").asc(), F.col("final_loss").asc(), "method", "dataset")
    return e.select("method", "dataset", F.row_number().over(w).cast("long").alias("rank"))


@register("g11_best_of",
          lambda: S.with_views("SELECT arg_max(method || '/' || dataset, efficiency) AS most_efficient, "
                               "arg_min(method || '/' || dataset, seconds) AS fastest, arg_min(method || '/' || dataset, final_loss) "
                               "AS lowest_loss, round(max(efficiency), 6) AS best_efficiency FROM eff", "runs",
                               extra=[("eff", _eff_sql())]))
def g11_best_of(spark, sf):
    from ..operators.metrics import efficiency_table
    e = efficiency_table(TB.runs(spark, sf)).withColumn("run", F.concat_ws("/", "method", "dataset"))
    return e.agg(F.max_by("run", "efficiency").alias("most_efficient"), F.min_by("run", "seconds").alias("fastest"),
                 F.min_by("run", "final_loss").alias("lowest_loss"), F.round(F.max("efficiency"), 6).alias("best_efficiency"))


# G12 / A8 ------------------------------------------------------------------
@register("g12_top_n_per_group",
          lambda: "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, "
                  "doc_id) AS rank FROM documents) x WHERE rank <= 5")
def g12_top_n_per_group(spark, sf):
    t = G.top_n_per_group(_docs(spark, sf).select("lang", "doc_id", "n_chars"), ["lang"],
                          [F.col("n_chars").desc(), F.col("doc_id")], 5)
    return t.select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@register("a8_head_limit", lambda: "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def a8_head_limit(spark, sf):
    return G.head(_docs(spark, sf).select("doc_id"), 25, "doc_id")


@register("g13_token_budget_batches")
def g13_token_budget_batches(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.col("n_chars").cast("long").alias("length"))
    return G.token_budget_batches(d, "length", "doc_id", max_len=2048)
