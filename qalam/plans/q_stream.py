"""Streaming queries (K*): each runs its stream to completion with the
``availableNow`` trigger and returns the sink contents. K4 also has a batch
twin checked against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as TB
from ..streaming import jobs as K
from . import sqlref as S
from .catalog import register


def _clean_tagged_sql():
    return S.with_views(
        f"SELECT doc_id, dialect, round(confidence, 6) AS confidence, round({S.quality_score('text')}, 6) AS quality_score "
        f"FROM tagged WHERE {S.quality_score('text')} >= 0.6", "ar_docs",
        extra=[("cleaned", f"SELECT doc_id, {S.clean_text('text')} AS text, lang, source FROM ar_docs"),
               ("tagged", S.detect_dialect_select("cleaned", keep="doc_id, text, lang, source"))])


def _tagged_sql(body):
    return S.with_views(body, "ar_docs", extra=[("tagged", S.detect_dialect_select("ar_docs", keep="doc_id, text, lang, source"))])


_WINDOWS_SQL = ("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id AS run, round(avg(value), 6) AS mean_value, "
                "count(*) AS n FROM events GROUP BY 1, 2")


@register("k1_stream_ingest", _clean_tagged_sql)
def k1_stream_ingest(spark, sf):
    return K.ingest(spark, sf).select("doc_id", "dialect", F.round("confidence", 6).alias("confidence"),
                                      F.round("quality_score", 6).alias("quality_score"))


@register("k2_running_dialect_counts",
          lambda: _tagged_sql("SELECT dialect, count(*) AS n FROM tagged WHERE text <> '' GROUP BY dialect"))
def k2_running_dialect_counts(spark, sf):
    return K.running_dialect_counts(spark, sf)


@register("k3_stream_dedup", lambda: f"SELECT DISTINCT {S.normalized_hash('text')} AS h FROM documents")
def k3_stream_dedup(spark, sf):
    """The texts that pass; which of equal ones passes depends on their arrival."""
    return K.stream_dedup(spark, sf).select("h")


@register("k4_stream_metric_windows", lambda: f"SELECT *, CAST(0 AS BIGINT) AS n_late FROM ({_WINDOWS_SQL}) w")
def k4_stream_metric_windows(spark, sf):
    """Read as one micro-batch nothing is late; over several, n + n_late is the batch's n."""
    return K.stream_metric_windows(spark, sf).select(
        "window_start", "run", F.round("mean_value", 6).alias("mean_value"), "n", "n_late")


@register("k4_metric_windows_batch",
          lambda: _WINDOWS_SQL)
def k4_metric_windows_batch(spark, sf):
    e = TB.table(spark, sf, "events")
    return K.metric_windows(e).select("window_start", "run", F.round("mean_value", 6).alias("mean_value"), "n")


_TREND_SQL = ("SELECT run, CAST(n_points AS BIGINT) AS n_points, trend, trend = 'increasing' AND n_points > 50 AS should_stop FROM ("
              "SELECT run, n_points, CASE WHEN n_points <= 10 THEN 'insufficient' WHEN recent > prev * 1.05 THEN 'increasing' "
              "WHEN recent < prev * 0.95 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT run, count(*) AS n_points, "
              "avg(CASE WHEN k <= 10 THEN value END) AS recent, avg(CASE WHEN k > 10 AND k <= 20 THEN value END) AS prev FROM ("
              "SELECT user_id AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k "
              "FROM events) a WHERE k <= 100 GROUP BY run) b) c")
_STOP_SQL = ("WITH s AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
             "AS best_before FROM metric_log), i AS (SELECT *, sum(CAST(best_before IS NULL OR value < best_before AS INTEGER)) OVER "
             "(PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM s), "
             "w AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS wait FROM i) "
             "SELECT run, min(value) AS best_value, count(*) AS n_seen, min(CASE WHEN wait >= 3 THEN step END) AS stop_step FROM w GROUP BY run")


@register("k5_live_loss_trend",
          lambda: S.with_views("SELECT run, n_points, trend, should_stop, n_seen, best_value, stop_step, CAST(0 AS BIGINT) AS n_late "
                               f"FROM ({_TREND_SQL}) t JOIN ({_STOP_SQL}) e USING (run)", "metric_log"))
def k5_live_loss_trend(spark, sf):
    """Trend and early stop of the stream, as W3 and W4 give them in batch."""
    return K.live_loss_trend(spark, sf)


@register("k6_capped_balanced_sink",
          lambda: _tagged_sql("SELECT doc_id, dialect FROM (SELECT doc_id, dialect, row_number() OVER (PARTITION BY dialect ORDER BY "
                              + S.u(42, "doc_id") + ", doc_id) AS r FROM tagged WHERE confidence > 0.3) x WHERE r <= 40"))
def k6_capped_balanced_sink(spark, sf):
    return K.capped_balanced_sink(spark, sf).select("doc_id", "dialect")
