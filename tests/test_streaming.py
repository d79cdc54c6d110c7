"""Streaming runs agree with their batch twins."""

from qalam.operators import dedup as DD
from qalam.operators import dialect as D
from qalam.sources import tables as TB
from qalam.streaming import jobs as K

from conftest import SF_SMALL


def test_running_counts_equal_batch(spark):
    s = {r["dialect"]: r["n"] for r in K.running_dialect_counts(spark, SF_SMALL).collect()}
    b = {r["dialect"]: r["n"] for r in D.analyze_dialects(D.detect_dialect(TB.ar_docs(spark, SF_SMALL))).collect()}
    assert s == b


def test_stream_dedup_equals_batch(spark):
    s = K.stream_dedup(spark, SF_SMALL).count()
    b = DD.exact_dedup(TB.table(spark, SF_SMALL, "documents"), "text", "doc_id").count()
    assert s == b
