"""Structured Streaming operators.

Sources are file streams with explicit schemas; sinks and checkpoints live
under the cluster's shared checkpoint folder (``spark.checkpoint.dir``), so a
restarted query resumes exactly where it stopped. ``run_available`` drives a
query with the ``availableNow`` trigger (all input now, then stop), which is
how the registered queries and tests exercise them.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialect as D
from ..operators import quality as Q
from ..session import ensure_checkpoint_dir
from ..sources import io as IO
from ..sources import tables as TB

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:8]}"


#: Session setting: files that a micro-batch takes at most (unset: all there are).
FILES_PER_TRIGGER = "qalam.stream.files.per.trigger"


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: str, max_files: int | None = None) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of files."""
    folder, table = sf_dir.rstrip("/"), f"{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    r = spark.readStream.schema(schema)
    max_files = max_files or spark.conf.get(FILES_PER_TRIGGER, None)
    if max_files:
        r = r.option("maxFilesPerTrigger", int(max_files))
    return r.parquet(f"{folder}/{table}") if whole else r.option("pathGlobFilter", table).parquet(folder)


def arabise(df: DataFrame) -> DataFrame:
    """The ``ar_docs`` derivation as stateless expressions (works on streams)."""
    k = (F.col("doc_id") % TB.N_PHRASES).cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x, _ in TB.PHRASES]), k + 1)
    phrase = F.element_at(F.array(*[F.lit(p) for _, p in TB.PHRASES]), k + 1)
    tr = F.translate(F.lower(F.col("text")), TB.LATIN, TB.ARABIC26)
    text = (F.when(kind == "blank", F.lit("")).when(kind == "latin", F.col("text")).when(kind == "plain", tr)
            .otherwise(F.concat(phrase, F.lit("\n"), tr)))
    return df.select("doc_id", text.alias("text"), "lang", "source")


def run_available(stream_df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
                  foreach_batch=None) -> None:
    w = stream_df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", sink_path).start()
    q.awaitTermination()


def ingest(spark: SparkSession, sf_dir: str, min_quality: float = 0.6) -> DataFrame:
    """K1: clean -> tag dialect -> quality score filter -> append sink."""
    base = work_dir(spark, "ingest")
    s = arabise(stream_table(spark, sf_dir, "documents", DOC_SCHEMA))
    s = s.withColumn("text", T.clean_text("text"))
    s = D.detect_dialect(s)
    s = D.evaluate_once(s, {"quality_score": Q.quality_check(F.col("text"))["quality_score"]}).filter(F.col("quality_score") >= min_quality)
    run_available(s, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


def running_dialect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: running count per dialect (complete mode), each micro-batch's
    totals written over the previous ones by ``foreachBatch``."""
    base = work_dir(spark, "counts")
    s = D.detect_dialect(arabise(stream_table(spark, sf_dir, "documents", DOC_SCHEMA)))
    counts = s.filter(F.col("text") != "").groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))
    out = f"{base}/out"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)
    run_available(counts, out, f"{base}/ckpt", mode="complete", foreach_batch=write)
    return spark.read.parquet(out)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A session setting for the queries started inside; the caller's own is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: exact dedup on the normalised-text hash against everything seen before.

    The seen set is keyed state that never expires, so a copy is dropped
    however late it comes and no row is late. It is spread over the state
    partitions by hash and kept in RocksDB, on disk: a hash and a key each.
    Of equal texts the first to arrive passes.
    """
    base = work_dir(spark, "dedup")
    s = stream_table(spark, sf_dir, "documents", DOC_SCHEMA).select("doc_id", T.normalized_hash("text").alias("h"))
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        run_available(s.dropDuplicates(["h"]), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


def metric_windows(df: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """K4 logic in batch: per-run tumbling / sliding means."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return df.groupBy(w.alias("w"), F.col("user_id").alias("run")).agg(F.avg("value").alias("mean_value"),
                                                                       F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("window_start"), "run", "mean_value", "n")


def _bound(spark: SparkSession, state: str, batch_id: int):
    """The event-time bound that batch ``batch_id`` left behind; none before the first batch."""
    path = f"{state}/{batch_id}/bound"
    return spark.read.schema("bound timestamp").parquet(path).first().bound if batch_id >= 0 and IO.exists(spark, path) else None


def _next_bound(rows: DataFrame, before, late: str, path: str):
    """Largest event time so far less the allowed lateness, written for the batches to come; it never falls."""
    spark = rows.sparkSession
    rows.agg(F.greatest(F.max("ts") - F.expr(f"INTERVAL {late}"), F.lit(before).cast("timestamp")).alias("bound")) \
        .write.mode("overwrite").parquet(path)
    return spark.read.schema("bound timestamp").parquet(path).first().bound


def stream_metric_windows(spark: SparkSession, sf_dir: str, late: str = "10 minutes", size: str = "1 hour",
                          slide: str | None = None) -> DataFrame:
    """K4: windowed means with a bound on late data, and the late rows kept apart.

    A window is closed when the bound, the largest event time of the earlier
    micro-batches less ``late``, has passed its end. A batch adds its rows'
    partial sums to the open windows; rows of closed windows go to a side sink
    instead of being lost. Both sinks are written per batch id, so a batch
    that is run again writes over itself, and a window's row is the sum of
    its partial sums. ``n`` counts the rows of the mean, ``n_late`` those that
    came too late for it.
    """
    base = work_dir(spark, "windows")
    state, sums, side = f"{base}/state", f"{base}/sums", f"{base}/late"
    w = F.window("ts", size, slide) if slide else F.window("ts", size)

    def write(batch, batch_id):
        sp = batch.sparkSession
        before = _bound(sp, state, batch_id - 1)
        rows = batch.select(w.alias("w"), F.col("user_id").alias("run"), "value", "event_id", "ts")
        closed = F.lit(False) if before is None else F.col("w.end") <= F.lit(before)
        rows.filter(~closed).groupBy(F.col("w.start").alias("window_start"), "run").agg(
            F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n")) \
            .write.mode("overwrite").parquet(f"{sums}/batch_id={batch_id}")
        rows.filter(closed).select(F.col("w.start").alias("window_start"), "run", "event_id", "ts", "value") \
            .write.mode("overwrite").parquet(f"{side}/batch_id={batch_id}")
        _next_bound(batch, before, late, f"{state}/{batch_id}/bound")
    run_available(stream_table(spark, sf_dir, "events", EVENT_SCHEMA), sums, f"{base}/ckpt", foreach_batch=write)
    keys = ["window_start", "run"]
    merged = spark.read.parquet(sums).groupBy(*keys).agg(
        (F.sum("total") / F.sum("n_values")).alias("mean_value"), F.sum("n").alias("n"))
    missed = spark.read.parquet(side).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_late"))
    return merged.join(missed, keys, "full_outer").fillna(0, ["n", "n_late"]).select(*keys, "mean_value", "n", "n_late")


def _fold(stopped: DataFrame, rows: DataFrame, patience: int) -> DataFrame:
    """Early-stop state ``(run, n, best, wait, stop_step)`` carried on over rows that all come after it."""
    from ..operators.ranking import grouped_row_number
    from ..operators.windows import early_stopping
    steps = grouped_row_number(rows.select("run", "ts", "event_id", "value"), ["run"], ["ts", "event_id"], "step")
    more = early_stopping(steps, patience=patience, start=stopped.select("run", "best", "wait")).select(
        "run", F.col("best_value").alias("_best"), F.col("n_points").alias("_n"), F.col("stop_step").alias("_stop"),
        F.col("wait").alias("_wait"))
    n = F.coalesce("n", F.lit(0))
    return stopped.join(more, "run", "full_outer").select(
        "run", (n + F.coalesce("_n", F.lit(0))).cast("long").alias("n"), F.least("best", "_best").alias("best"),
        F.coalesce("_wait", "wait").cast("long").alias("wait"),
        F.coalesce("stop_step", n + F.col("_stop")).cast("long").alias("stop_step"))


def live_loss_trend(spark: SparkSession, sf_dir: str, patience: int = 3, late: str = "30 days", window: int = 10,
                    buffer: int = 100) -> DataFrame:
    """K5: per run the live trend (W3) and early stop (W4) of its points.

    Points come in any order; what counts is their order by (ts, event_id).
    Points before the bound (the largest event time of the earlier batches
    less ``late``) are settled: they are folded into a run's early-stop state
    of five numbers and not kept. Later ones stay open until the bound has
    passed them, quiet runs included. Points that come behind the bound are
    counted in ``n_late``. The trend needs a run's last ``buffer`` points,
    which are kept besides. All state is tables written per batch id, so a
    batch run again writes over itself; a batch is folded by range slices
    (``early_stopping``), so a run with most of the points is many tasks.
    """
    from ..operators.windows import loss_trend
    base = work_dir(spark, "trend")
    state = f"{base}/state"
    points, stop = "run long, ts timestamp, event_id long, value double", "run long, n long, best double, wait long, stop_step long"

    def saved(sp, batch_id, name, schema):
        path = f"{state}/{batch_id}/{name}"
        return sp.read.schema(schema).parquet(path) if batch_id >= 0 and IO.exists(sp, path) else sp.createDataFrame([], schema)

    def put(df, batch_id, name, schema):
        df.write.mode("overwrite").parquet(f"{state}/{batch_id}/{name}")
        return saved(df.sparkSession, batch_id, name, schema)

    def write(batch, batch_id):
        sp = batch.sparkSession
        before = _bound(sp, state, batch_id - 1)
        behind = F.lit(False) if before is None else F.col("ts") < F.lit(before)
        put(batch.filter(behind).groupBy("run").agg(F.count(F.lit(1)).alias("n_late")), batch_id, "late", "run long, n_late long")
        on_time = batch.filter(~behind)
        earlier = saved(sp, batch_id - 1, "open", points)
        waiting = earlier if before is None else earlier.filter(F.col("ts") >= F.lit(before))
        open_ = put(waiting.unionByName(on_time), batch_id, "open", points)
        newest = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ts"), F.desc("event_id")))
        put(saved(sp, batch_id - 1, "tail", points).unionByName(on_time).withColumn("_k", newest)
            .filter(F.col("_k") <= buffer).drop("_k"), batch_id, "tail", points)
        bound = _next_bound(batch, before, late, f"{state}/{batch_id}/bound")
        settled = open_.filter(F.lit(False) if bound is None else F.col("ts") < F.lit(bound))
        stopped = saved(sp, batch_id - 1, "stopped", stop)
        put(stopped if settled.isEmpty() else _fold(stopped, settled, patience), batch_id, "stopped", stop)
        last[0] = batch_id

    last = [-1]
    events = stream_table(spark, sf_dir, "events", EVENT_SCHEMA).select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    run_available(events, state, f"{base}/ckpt", foreach_batch=write)
    bound, open_ = _bound(spark, state, last[0]), saved(spark, last[0], "open", points)
    rest = open_ if bound is None else open_.filter(F.col("ts") >= F.lit(bound))
    stops = _fold(saved(spark, last[0], "stopped", stop), rest, patience)
    step = F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id"))  # at most `buffer` points a run
    trend = loss_trend(saved(spark, last[0], "tail", points).withColumn("step", step), window=window, buffer=buffer)
    missed = spark.read.schema("run long, n_late long").parquet(f"{state}/*/late").groupBy("run").agg(
        F.sum("n_late").alias("n_late")) if last[0] >= 0 else spark.createDataFrame([], "run long, n_late long")
    return stops.join(trend.select("run", "n_points", "trend", "should_stop"), "run", "left").join(missed, "run", "left").select(
        "run", "n_points", "trend", "should_stop", F.col("n").alias("n_seen"), F.col("best").alias("best_value"), "stop_step",
        F.coalesce("n_late", F.lit(0)).alias("n_late"))


def capped_balanced_sink(spark: SparkSession, sf_dir: str, cap: int = 40, seed: int = 42) -> DataFrame:
    """K6: append at most ``cap`` rows per dialect over the whole stream. The
    per-dialect totals so far are kept as a small table next to the sink and
    read at each micro-batch; each batch ranks its rows per dialect by u."""
    W = Window
    base = work_dir(spark, "capped")
    out, totals = f"{base}/out", f"{base}/totals"
    s = D.detect_dialect(arabise(stream_table(spark, sf_dir, "documents", DOC_SCHEMA))).filter(F.col("confidence") > 0.3)

    def write(batch, batch_id):
        sp = batch.sparkSession
        seen = sp.createDataFrame([], "dialect string, taken long")
        if batch_id and IO.exists(sp, f"{totals}/{batch_id - 1}"):
            seen = sp.read.schema("dialect string, taken long").parquet(f"{totals}/{batch_id - 1}")
        # the rank up to a literal cap is a group limit: no task sorts a whole dialect; texts join the winners
        at = F.struct(T.u(seed, F.col("doc_id")).alias("u"), "doc_id")
        ranked = batch.select("dialect", "doc_id").withColumn("__r", F.row_number().over(W.partitionBy("dialect").orderBy(at))) \
            .filter(F.col("__r") <= cap)
        picked = ranked.join(seen, "dialect", "left").filter(
            F.col("__r") <= F.lit(cap) - F.coalesce(F.col("taken"), F.lit(0))).select("doc_id", "dialect")
        # a replayed batch writes over itself
        batch.join(picked.select("doc_id"), "doc_id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        taken = sp.read.schema(batch.schema).parquet(f"{out}/batch_id={batch_id}").groupBy("dialect").agg(F.count(F.lit(1)).alias("c"))
        taken.join(seen, "dialect", "full_outer").select(
            "dialect", (F.coalesce("taken", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("taken")
        ).write.mode("overwrite").parquet(f"{totals}/{batch_id}")
    run_available(s, out, f"{base}/ckpt", foreach_batch=write)
    return spark.read.parquet(out).drop("batch_id")
