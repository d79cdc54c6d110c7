"""Quotas by thresholds, slices of runs and conversations, and streams over many micro-batches, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from qalam.functions import text as T
from qalam.functions import udfs
from qalam.operators import quota as QT
from qalam.operators import sampling as G
from qalam.operators import windows as W
from qalam.sources import tables as TB
from qalam.streaming import jobs as K

from conftest import SF_SMALL


def in_order(spark, keys, seed=42):
    """Keys by (u, key)."""
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", T.u(seed, F.col("k")).alias("u")).collect()
    return [r.k for r in sorted(rows, key=lambda r: (r.u, r.k))]


@pytest.mark.parametrize("parts", [1, 8, 37])
def test_quotas_are_the_smallest_by_u_whatever_the_partitions(spark, parts):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(parts).withColumn("text", F.lit("words of a text"))
    order = in_order(spark, range(900))
    quotas = {"hot": 100, "g0": 0, "g1": 1, "g2": 10_000, "g3": 5, "absent": 4}
    q = spark.createDataFrame(list(quotas.items()), "g string, quota long")
    got = QT.smallest(df, ["g"], q, "k")
    of = dict(rows)
    want = {k for g, n in quotas.items() for k in [k for k in order if of[k] == g][:n]}
    assert sorted(r.k for r in got.select("k").collect()) == sorted(want) and got.columns == df.columns
    assert "text" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in x)
    assert sorted(r.k for r in G.random_sample(df, 17, "k").collect()) == sorted(order[:17])
    split = {r.k: r.split for r in G.split(df, "k", 0.8, 0.1, 0.1).collect()}
    assert split == {k: "train" if i < 720 else "validation" if i < 810 else "test" for i, k in enumerate(order)}
    two = [r.split for r in G.split(df, "k", 0.5, 0.5, 0.0).collect()]
    assert two.count("train") == 450 and two.count("validation") == 450


def test_quotas_of_ties_many_groups_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(T, "u", lambda seed, key: F.lit(0.25))  # all tie: the keys decide
    df = spark.createDataFrame([(i, i % 2) for i in range(200)], "k long, g int")
    q = spark.createDataFrame([(0, 3), (1, 7)], "g int, quota long")
    want = [0, 1, 2, 3, 4, 5, 7, 9, 11, 13]
    assert sorted(r.k for r in QT.smallest(df, ["g"], q, "k").collect()) == want
    monkeypatch.setattr(QT, "BROADCAST_ROWS", 0)
    assert sorted(r.k for r in QT.smallest(df, ["g"], q, "k").collect()) == want
    assert QT.smallest(df.limit(0), ["g"], q, "k").collect() == []
    assert G.random_sample(df.limit(0), 5, "k").collect() == [] and G.split(df.limit(0), "k").collect() == []


def slow_stop(values, patience, delta, best=None, wait=0):
    stop = None
    for i, v in enumerate(values, 1):
        if best is None or v < best - delta:
            wait = 0
        else:
            wait += 1
            if wait >= patience and stop is None:
                stop = i
        best = v if best is None else min(best, v)
    return best, stop, wait


@pytest.mark.parametrize("parts, patience, delta", [(1, 3, 0.0), (8, 3, 0.0), (37, 5, 0.05), (37, 1, 0.0), (8, 40, 0.0)])
def test_early_stop_of_sliced_runs(spark, parts, patience, delta):
    rng = random.Random(parts * patience)
    runs = {0: [round(3 / (1 + i / 40) + rng.random() * 0.4, 3) for i in range(1500)]}  # a hot run
    runs |= {r: [rng.choice([0.1, 0.2, 0.3, 0.5]) for _ in range(rng.randrange(1, 30))] for r in range(1, 40)}
    runs |= {100: [float(-i) for i in range(50)], 101: [float(i) for i in range(50)], 102: [1.0] * 60}
    rows = [(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs, 1)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "run long, step long, value double")
    got = {r.run: (r.best_value, r.stop_step, r.wait, r.n_points)
           for r in W.early_stopping(log, patience=patience, min_delta=delta, num_partitions=parts).collect()}
    assert got == {r: (*slow_stop(vs, patience, delta), len(vs)) for r, vs in runs.items()}
    start = spark.createDataFrame([(0, 2.0, 2), (101, -5.0, 0), (102, 0.5, 7), (999, 0.0, 1)], "run long, best double, wait long")
    known = {0: (2.0, 2), 101: (-5.0, 0), 102: (0.5, 7)}
    got = {r.run: (r.stop_step, r.wait) for r in W.early_stopping(log, patience=patience, min_delta=delta, start=start,
                                                                  num_partitions=parts).collect()}
    for r, vs in runs.items():
        best, wait = known.get(r, (None, 0))
        _, stop, after = slow_stop(vs, patience, delta, best, wait)
        if wait < patience:  # else it had stopped before
            assert got[r] == (stop, after), r


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_turns_are_paired_across_slices(spark, block):
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{c}-{t}")
            for c in range(12) for t in sorted(rng.sample(range(-5, 60), 40 if c else 60))]
    got = sorted(tuple(r) for r in W.pair_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"),
                                                block=block).collect())
    want = [(a[0], a[1], a[3], b[3]) for a, b in zip(rows, rows[1:])
            if a[0] == b[0] and a[2] == "user" and b[2] == "assistant"]
    assert got == sorted(want) and want


def test_row_windows_are_not_partitioned_by_run_or_conversation(spark):
    def windows(df):
        return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if " Window " in x or x.startswith("Window")]
    log = spark.createDataFrame([(1, 1, 0.5)], "run long, step long, value double")
    by_row = [x for x in windows(W.early_stopping(log)) if "step" in x]
    assert by_row and all("_pid" in x for x in by_row)
    conv = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn int, role string, text string")
    by_row = [x for x in windows(W.pair_turns(conv)) if "turn" in x]
    assert by_row and all("__block" in x.split("], [")[1] for x in by_row)


def slow_lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(1)
    for n in range(300):
        x, y = ([rng.choice("abcdefgh"[:1 + n % 8]) for _ in range(rng.randrange(0, 150))] for _ in range(2))
        assert udfs.lcs(x, y) == slow_lcs(x, y)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Six files of each table, out of id and time order, one a micro-batch."""
    folder = str(tmp_path_factory.mktemp("shuffled"))
    for t in ("documents", "events"):
        d = TB.table(spark, SF_SMALL, t)
        d.repartition(6, F.rand(5)).write.parquet(f"{folder}/{t}.parquet")
    spark.conf.set(K.FILES_PER_TRIGGER, "1")
    yield folder
    spark.conf.unset(K.FILES_PER_TRIGGER)


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    """Five files of events in time order (files are read in the order of their writing)."""
    folder = str(tmp_path_factory.mktemp("ordered"))
    e = TB.table(spark, SF_SMALL, "events")
    n = e.count()
    e = e.withColumn("_k", F.percent_rank().over(W.Window.orderBy("ts", "event_id")))
    for k in range(5):
        e.filter((F.col("_k") * 5).cast("int") == k if k < 4 else F.col("_k") >= 0.8).drop("_k").coalesce(1) \
            .write.mode("append").parquet(f"{folder}/events.parquet")
    assert spark.read.parquet(f"{folder}/events.parquet").count() == n
    yield folder


def test_seen_set_is_whole_over_micro_batches(spark, shuffled):
    want = {r.h for r in TB.table(spark, SF_SMALL, "documents").select(T.normalized_hash("text").alias("h")).collect()}
    got = [r.h for r in K.stream_dedup(spark, shuffled).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_late_rows_are_kept_apart(spark, shuffled):
    batch = {(r.window_start, r.run): (r.n, r.mean_value) for r in K.metric_windows(TB.table(spark, SF_SMALL, "events")).collect()}
    got = {(r.window_start, r.run): r for r in K.stream_metric_windows(spark, shuffled).collect()}
    assert {k: r.n + r.n_late for k, r in got.items()} == {k: n for k, (n, _) in batch.items()}
    assert any(r.n_late for r in got.values()) and any(r.n for r in got.values())
    assert all(r.mean_value == pytest.approx(batch[k][1]) for k, r in got.items() if not r.n_late)
    patient = K.stream_metric_windows(spark, shuffled, late="3650 days").collect()
    assert {(r.window_start, r.run): (r.n, r.n_late) for r in patient} == {k: (n, 0) for k, (n, _) in batch.items()}


def check_live(spark, folder, late):
    log = TB.metric_log(spark, SF_SMALL)
    trend = {r.run: (r.n_points, r.trend, r.should_stop) for r in W.loss_trend(log).collect()}
    stop = {r.run: (r.n_points, r.best_value, r.stop_step) for r in W.early_stopping(log).collect()}
    got = K.live_loss_trend(spark, folder, late=late).collect()
    assert {r.run: (r.n_points, r.trend, r.should_stop) for r in got} == trend
    assert {r.run: (r.n_seen, r.best_value, r.stop_step) for r in got} == stop and all(r.n_late == 0 for r in got)


def test_live_trend_and_stop_of_shuffled_points(spark, shuffled):
    check_live(spark, shuffled, "3650 days")
    got = K.live_loss_trend(spark, shuffled, late="1 hour").collect()
    assert sum(r.n_seen + r.n_late for r in got) == TB.table(spark, SF_SMALL, "events").count()
    assert any(r.n_late for r in got)


def test_live_trend_and_stop_of_settled_points(spark, ordered, shuffled):
    check_live(spark, ordered, "1 second")
