"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .dialect import contained_terms


def best_negatives(cands: DataFrame, id_col: str, chosen: str, neg: str, pos_col: str, k: int) -> DataFrame:
    """top-k candidates by 0.4 (1 - |dq|) + 0.3 (1 - sim) + 0.3 min(1/(|dq|+.1)/10, 1);
    ties keep the earlier candidate."""
    qc, qn = T.quality(chosen), T.quality(neg)
    gap = F.abs(qc - qn)
    score = 0.4 * (1.0 - gap) + 0.3 * (1.0 - T.sim(neg, chosen)) + 0.3 * F.least(1.0 / (gap + 0.1) / 10.0, F.lit(1.0))
    w = Window.partitionBy(id_col).orderBy(score.desc(), F.col(pos_col))
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def adaptive_negatives(q: Column, negs: Column, progress: float) -> Column:
    """F8: negatives whose signed quality gap (chosen minus negative) lies in a
    band that narrows with training progress: [0.1 + 0.4 (1-p), 0.8 - 0.3 p]."""
    lo, hi = 0.1 + 0.4 * (1 - progress), 0.8 - 0.3 * progress
    return F.filter(negs, lambda n: (q - T.quality(n) >= lo) & (q - T.quality(n) <= hi))


def results_with_models(results: DataFrame, models: DataFrame, order_col: str) -> DataFrame:
    """results left-joined to the model list on (method, dataset); with
    duplicate model rows the last one (largest ``order_col``) wins."""
    last = models.groupBy("method", "dataset").agg(F.max_by("path", order_col).alias("path"))
    return results.join(last, ["method", "dataset"], "left")


def missing_artefacts(models: DataFrame, required: list[str], present: DataFrame) -> DataFrame:
    """expected (model x required file) minus present, by anti join.
    The required-file list is a literal array exploded per model row."""
    expected = models.select("method", "dataset", F.explode(F.array(*[F.lit(x) for x in required])).alias("file"))
    return expected.join(present, ["method", "dataset", "file"], "left_anti")


def column_diff(df: DataFrame, required: list[str]) -> DataFrame:
    """missing and extra columns against a required list (schema only)."""
    spark = df.sparkSession
    have = set(df.columns)
    rows = [("missing", c) for c in required if c not in have] + [("extra", c) for c in sorted(have - set(required))]
    return spark.createDataFrame(rows, "kind string, column_name string")


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """inner join of two long (metric, value) tables: difference,
    relative improvement in percent (denominator max(|v2|, 1e-8)), better."""
    j = a.select("metric", F.col("value").alias("model_1")).join(b.select("metric", F.col("value").alias("model_2")), "metric")
    return j.select("metric", "model_1", "model_2", (F.col("model_1") - F.col("model_2")).alias("difference"),
                    ((F.col("model_1") - F.col("model_2")) / F.greatest(F.abs("model_2"), F.lit(1e-8)) * 100).alias("relative_improvement"),
                    F.when(F.col("model_1") > F.col("model_2"), F.lit("model_1")).otherwise(F.lit("model_2")).alias("better_model"))


def keyed_diff(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """full outer join on the key: common / only_left / only_right and
    the absolute difference against a tolerance."""
    j = left.select(key, F.col(value).alias("__l")).join(right.select(key, F.col(value).alias("__r")), key, "full_outer")
    side = F.when(F.col("__l").isNull(), F.lit("only_right")).when(F.col("__r").isNull(), F.lit("only_left")).otherwise(F.lit("common"))
    d = F.abs(F.col("__l") - F.col("__r"))
    return j.select(key, side.alias("side"), d.alias("abs_diff"), F.coalesce(d <= tolerance, F.lit(False)).alias("within_tolerance"))


def lexicon_table(spark) -> DataFrame:
    """The dialect lexicon as a small table (fixed size, broadcastable)."""
    rows = [(d, kind, term) for d in L.DIALECT_ORDER for kind, terms in L.DIALECT_FEATURES[d].items()
            if kind != "patterns" for term in terms]
    return spark.createDataFrame(rows, "dialect string, kind string, term string")


def lexicon_values_sql() -> str:
    from ..plans.sqlref import q
    rows = [(d, kind, term) for d in L.DIALECT_ORDER for kind, terms in L.DIALECT_FEATURES[d].items()
            if kind != "patterns" for term in terms]
    return "SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in rows) + ") v(dialect, kind, term)"


def lexicon_match(df: DataFrame, norm_col: str) -> DataFrame:
    """text x lexicon term where the normalised text contains the term:
    a projection finds a text's terms, an equi-join with the broadcast lexicon, of
    fixed size, gives their rows."""
    lex = lexicon_table(df.sparkSession)
    terms = [t for feats in L.DIALECT_FEATURES.values() for kind in feats if kind != "patterns" for t in feats[kind]]
    found = df.select("*", F.explode(contained_terms(F.col(norm_col), terms)).alias("term"))
    return found.join(F.broadcast(lex), "term").select(*df.columns, "dialect", "kind", "term")


def pair_predictions(pred: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """F16: predictions paired with references on the example key."""
    return pred.join(ref, keys)


def concatenate(frames: list[DataFrame]) -> DataFrame:
    """union all by column name (missing columns become null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
