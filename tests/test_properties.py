"""Property checks: exact split counts, partition invariance, dedup, quotas,
greedy near-dup against a brute-force scan."""

from pyspark.sql import functions as F

from qalam.operators import dedup as DD
from qalam.operators import dialect as D
from qalam.operators import sampling as G
from qalam.operators.ranking import grouped_row_number
from qalam.sources import tables as TB

from conftest import SF_SMALL


def test_split_exact_and_disjoint(spark):
    d = TB.table(spark, SF_SMALL, "documents").select("doc_id")
    n = d.count()
    s = G.split(d, "doc_id", 0.8, 0.1, 0.1)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    import math
    held = math.ceil((0.1 + 0.1) * n)
    n_test = math.ceil((1 - 0.1 / (0.1 + 0.1)) * held)
    assert counts == {"train": n - held, "validation": held - n_test, "test": n_test}
    assert s.select("doc_id").distinct().count() == n


def test_partition_invariance(spark):
    d = TB.table(spark, SF_SMALL, "documents").select("doc_id", "lang")
    def rows(df):
        return sorted((r["doc_id"], r["lang"], r["rn"]) for r in df.collect())
    a = rows(grouped_row_number(d, ["lang"], ["doc_id"], "rn", num_partitions=1))
    b = rows(grouped_row_number(d, ["lang"], ["doc_id"], "rn", num_partitions=8))
    assert a == b
    from pyspark.sql import Window
    w = Window.partitionBy("lang").orderBy("doc_id")
    assert a == rows(d.withColumn("rn", F.row_number().over(w).cast("long")))


def test_exact_dedup_idempotent(spark):
    d = TB.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    once = DD.exact_dedup(d, "text", "doc_id")
    twice = DD.exact_dedup(once, "text", "doc_id")
    assert once.count() == twice.count()


def test_balance_quotas(spark):
    tagged = D.detect_dialect(TB.ar_docs(spark, SF_SMALL))
    b = D.balance_by_dialect(tagged, "doc_id", target=10, texts=TB.ar_docs(spark, SF_SMALL))
    per = {r["dialect"]: r["count"] for r in b.groupBy("dialect").count().collect()}
    assert per and all(v == 10 for v in per.values())


def _brute_greedy(rows, t):
    def sig(text):
        w = text.lower().split()
        if len(w) < 3:
            return {" ".join(w)}
        return {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}

    kept, sigs = [], []
    for doc_id, text in sorted(rows):
        s = sig(text)
        if any((len(s & k) / len(s | k) if s and k else 0.0) >= t for k in sigs):
            continue
        kept.append(doc_id)
        sigs.append(s)
    return kept


def test_near_dedup_matches_brute_force(spark):
    d = TB.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = sorted(r["doc_id"] for r in DD.near_dedup(d, "text", "doc_id", 0.8).collect())
    assert got == _brute_greedy(rows, 0.8)
