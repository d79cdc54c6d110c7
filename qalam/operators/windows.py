"""Window operators.

No row-level window is partitioned by a run or a conversation: either may
hold a third of all rows. Rows are cut into slices of bounded size, windows
run inside a slice, and small tables with a row per slice carry what one
slice must know of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import slices

#: Turn numbers that one slice of a conversation spans.
TURN_BLOCK = 4096


def pair_turns(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text", block: int = TURN_BLOCK) -> DataFrame:
    """Each user turn with the next turn when that turn is the assistant's.

    Output ``(conv_id, turn, instruction, response)``. Conversations are cut
    at every ``block`` turn numbers and paired slice by slice; the last turn
    of a slice meets the first turn of its conversation's next slice, which
    is fetched only where a conversation has several slices. Turn numbers are
    integers; repeated ones within a conversation have no order.
    """
    rows = conv.select(conv_col, turn_col, role_col, text_col, F.floor(F.col(turn_col) / block).alias("__block"))
    following = F.lead("__block").over(Window.partitionBy(conv_col).orderBy("__block"))
    cuts = rows.select(conv_col, "__block").distinct().withColumn("__next", following).filter(F.col("__next").isNotNull())
    heads = rows.join(cuts.select(conv_col, F.col("__next").alias("__block")), [conv_col, "__block"], "left_semi") \
        .groupBy(conv_col, "__block").agg(F.min_by(F.struct(role_col, text_col), turn_col).alias("__head"))
    border = cuts.join(heads.withColumnRenamed("__block", "__next"), [conv_col, "__next"]).select(conv_col, "__block", "__head")
    w = Window.partitionBy(conv_col, "__block").orderBy(turn_col)
    nxt = rows.withColumn("__after", F.lead(F.struct(role_col, text_col)).over(w)).join(border, [conv_col, "__block"], "left") \
        .withColumn("__after", F.coalesce("__after", "__head"))
    return nxt.filter((F.col(role_col) == "user") & (F.col("__after")[role_col] == "assistant")) \
        .select(conv_col, turn_col, F.col(text_col).alias("instruction"), F.col("__after")[text_col].alias("response"))


def loss_trend(log: DataFrame, run_col: str = "run", step_col: str = "step", value_col: str = "value",
               window: int = 10, threshold: float = 0.05, stop_after: int = 50, buffer: int = 100) -> DataFrame:
    """Per run, mean of the last ``window`` points vs the ``window`` before.

    Trend is 'increasing' when recent > previous * (1 + threshold),
    'decreasing' when recent < previous * (1 - threshold), else 'stable';
    runs with at most ``window`` points are 'insufficient'. With fewer than
    2*window points the previous mean covers whatever precedes the last
    window. ``should_stop`` = increasing and more than ``stop_after`` points
    in the last ``buffer``. Only the last ``buffer`` points of each run are
    needed, so ``row_number <= buffer`` (a WindowGroupLimit: each map task
    keeps at most ``buffer`` rows per run before the shuffle) bounds the work
    per run whatever its size.
    """
    w = Window.partitionBy(run_col).orderBy(F.col(step_col).desc())
    tail = log.select(run_col, value_col, F.row_number().over(w).alias("__k")).filter(F.col("__k") <= buffer)
    g = tail.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg(F.when(F.col("__k") <= window, F.col(value_col))).alias("recent_mean"),
        F.avg(F.when((F.col("__k") > window) & (F.col("__k") <= 2 * window), F.col(value_col))).alias("previous_mean"))
    recent, prev = F.col("recent_mean"), F.col("previous_mean")
    trend = (F.when(F.col("n_points") <= window, F.lit("insufficient"))
             .when(recent > prev * (1 + threshold), F.lit("increasing"))
             .when(recent < prev * (1 - threshold), F.lit("decreasing")).otherwise(F.lit("stable")))
    return g.select(run_col, "n_points", recent.alias("recent_mean"),
                    F.when(F.col("n_points") > window, prev).alias("previous_mean"), trend.alias("trend"),
                    ((trend == "increasing") & (F.col("n_points") > stop_after)).alias("should_stop"))


def early_stopping(log: DataFrame, run_col: str = "run", step_col: str = "step", value_col: str = "value",
                   patience: int = 3, min_delta: float = 0.0, start: DataFrame | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """Patience early stop on a lower-is-better metric.

    A point improves when value < best_so_far - min_delta (best over all
    earlier points). The counter of non-improving points resets on each
    improvement; the run stops at the first point where it reaches
    ``patience``. Output per run: best_value, n_points, stop_step (null when
    never) and ``wait``, the counter after the last point. ``start(run, best,
    wait)`` carries on from earlier points.

    A run is cut into slices of range partitions. The slices' minima, scanned
    in order, give the best value before each slice; with it a slice finds its
    improvements by itself and is summed up as: points before the first
    improvement (and the steps of the first ``patience`` of them), the first
    stop after it, points since the last one. A second scan over these rows,
    one a slice, carries the counter across slices.
    """
    cut = slices(log.select(F.col(run_col).alias("run"), F.col(step_col).alias("step"), F.col(value_col).alias("value")),
                 ["run"], ["step"], num_partitions)
    earlier = Window.partitionBy("run").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if start is None:
        start = log.select(F.col(run_col).alias("run")).limit(0).select(
            "run", F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("wait"))
    known = start.select(F.col(start.columns[0]).alias("run"), F.col("best").alias("_best0"), F.col("wait").alias("_wait0"))
    before = cut.groupBy("run", "_pid").agg(F.min("value").alias("_low")).withColumn("_before", F.min("_low").over(earlier)) \
        .join(known, "run", "left").select("run", "_pid", F.least("_before", "_best0").alias("_best"))
    in_slice = Window.partitionBy("run", "_pid").orderBy("step")
    best = F.least("_best", F.min("value").over(in_slice.rowsBetween(Window.unboundedPreceding, -1)))
    rows = cut.join(before, ["run", "_pid"]).withColumn("_so_far", best)
    improved = F.col("_so_far").isNull() | (F.col("value") < F.col("_so_far") - min_delta)
    # islands: an island starts at each improvement, island 0 is what comes before the first
    rows = rows.withColumn("_island", F.sum(improved.cast("int")).over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("run", "_pid", "_island").orderBy("step"))
    rows = rows.withColumn("_place", place)
    lead, wait = F.col("_island") == 0, F.col("_place") - 1
    summed = rows.groupBy("run", "_pid").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.count_if(lead).alias("lead"),
        F.sort_array(F.collect_list(F.when(lead & (F.col("_place") <= patience), F.col("step")))).alias("lead_steps"),
        F.min(F.when(~lead & (wait >= patience), F.col("step"))).alias("inner_stop"),
        F.max_by(F.when(~lead, wait), "step").alias("since")).join(known, "run", "left")
    since = F.coalesce("since", "lead")
    # the counter after a slice: what the last slice with an improvement left, and all points since
    group = F.sum(F.col("since").isNotNull().cast("int")).over(Window.partitionBy("run").orderBy("_pid"))
    summed = summed.withColumn("_since", since.cast("long")).withColumn("_group", group)
    run_on = Window.partitionBy("run", "_group").orderBy("_pid")
    after = F.sum("_since").over(run_on) + F.when(F.col("_group") == 0, F.coalesce("_wait0", F.lit(0))).otherwise(0)
    summed = summed.withColumn("_after", after)
    summed = summed.withColumn("_wait", F.coalesce(F.lag("_after").over(Window.partitionBy("run").orderBy("_pid")), "_wait0", F.lit(0)))
    place = (F.lit(patience) - F.col("_wait")).cast("int")
    lead_stop = F.when((place >= 1) & (place <= F.size("lead_steps")), F.get("lead_steps", place - 1))
    return summed.withColumn("_stop", F.coalesce(lead_stop, "inner_stop")).groupBy("run").agg(
        F.min("low").alias("best_value"), F.sum("n").alias("n_points"), F.min("_stop").alias("stop_step"),
        F.max_by("_after", "_pid").alias("wait")).withColumnRenamed("run", run_col)
