"""Dedup queries (F1-F3) over the driver's ``documents`` (exact and near copies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as DD
from ..sources import tables as TB
from . import sqlref as S
from .catalog import register


def _docs(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", "text")


# F1 ------------------------------------------------------------------------
@register("f1_exact_dedup",
          lambda: f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {S.normalized_hash('text')} "
                  "ORDER BY doc_id) AS rn FROM documents) x WHERE rn = 1")
def f1_exact_dedup(spark, sf):
    return DD.exact_dedup(_docs(spark, sf), "text", "doc_id").select("doc_id")


# F2 ------------------------------------------------------------------------
def _triples_sql():
    return ("SELECT id, prompt, chosen, rejected FROM pairs UNION ALL "
            "SELECT id + 1000000000, prompt, chosen, rejected FROM pairs WHERE id % 3 = 0")


@register("f2_triple_dedup",
          lambda: S.with_views("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY prompt, chosen, rejected "
                               "ORDER BY id) AS rn FROM t) x WHERE rn = 1", "pairs", extra=[("t", _triples_sql())]))
def f2_triple_dedup(spark, sf):
    """Pairs plus a re-listed copy of every third pair: copies must go."""
    p = TB.pairs(spark, sf).select("id", "prompt", "chosen", "rejected")
    t = p.unionByName(p.filter(F.col("id") % 3 == 0).withColumn("id", F.col("id") + 1000000000))
    return DD.triple_dedup(t, "id").select("id")


# F3 ------------------------------------------------------------------------
F3_THRESHOLD = 0.8


def _f3_sql(body: str) -> str:
    """``sets``, ``reps`` (first rows of equal sets) and ``e`` (similar pairs of them), then ``body``."""
    return (f"WITH RECURSIVE sets AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep, sig FROM (SELECT doc_id, "
            f"list_sort({S.shingles('text')}) AS sig FROM documents WHERE text IS NOT NULL) y), "
            "reps AS (SELECT doc_id, sig, len(sig) AS sz FROM sets WHERE doc_id = rep), "
            f"e AS (SELECT a.doc_id AS i, b.doc_id AS j, {S.jaccard('a.sig', 'b.sig', 0.0)} AS jaccard FROM reps a JOIN reps b "
            f"ON a.doc_id < b.doc_id AND least(a.sz, b.sz) >= greatest(a.sz, b.sz) * {F3_THRESHOLD} "
            f"WHERE {S.jaccard('a.sig', 'b.sig', 0.0)} >= {F3_THRESHOLD}) {body}")


@register("f3_similar_pairs",
          lambda: _f3_sql(f"SELECT i, j, {S.rnd('jaccard')} AS jaccard FROM e UNION ALL SELECT rep, doc_id, 1.0 FROM sets "
                          "WHERE rep < doc_id"))
def f3_similar_pairs(spark, sf):
    e = DD.near_dup_edges(_docs(spark, sf), "text", "doc_id", F3_THRESHOLD)
    return e.select("i", "j", F.round("jaccard", 6).alias("jaccard"))


def _f3_dedup_sql():
    # one document a step, in id order: kept unless a kept one is similar
    return _f3_sql(
        ", n AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, coalesce(list(e.i), []) AS near FROM "
        "(SELECT doc_id FROM reps WHERE doc_id IN (SELECT i FROM e) OR doc_id IN (SELECT j FROM e)) r "
        "LEFT JOIN e ON e.j = r.doc_id GROUP BY doc_id), "
        "g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT n.k, CASE WHEN list_has_any(g.kept, n.near) "
        "THEN g.kept ELSE list_append(g.kept, n.doc_id) END FROM g JOIN n ON n.k = g.k + 1) "
        "SELECT doc_id FROM reps WHERE doc_id NOT IN (SELECT i FROM e) AND doc_id NOT IN (SELECT j FROM e) "
        "UNION ALL SELECT unnest(kept) FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1) l "
        "UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")


@register("f3_near_dedup", _f3_dedup_sql)
def f3_near_dedup(spark, sf):
    """Greedy keep-first result; also checked against a brute-force scan in tests."""
    return DD.near_dedup(_docs(spark, sf), "text", "doc_id", F3_THRESHOLD).select("doc_id")
