"""Sampling, splitting, ordering and top-k.

Randomness is ``u(seed, key)`` (md5-based), so every result is independent
of partitioning and reproducible in SQL. Quotas (exact split sizes,
per-group targets) are thresholds on (u, key) from ``quota``, so a selection
is a filter; where the place itself is the result (G1, G5, G8) it is an exact
rank from ``ranking``: no single-task global window, no group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import quota as Q
from .ranking import global_row_number


def with_u(df: DataFrame, key_col: str, seed: int = 42, out: str = "__u") -> DataFrame:
    return df.withColumn(out, T.u(seed, F.col(key_col)))


def shuffle(df: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """G1: seeded shuffle = total order by (u, key); ``shuffle_rank`` is exact."""
    return global_row_number(with_u(df, key_col, seed), ["__u", key_col], "shuffle_rank").drop("__u")


def head(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """First ``n`` rows by ``order_col`` (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(order_col).limit(n)


def split(df: DataFrame, key_col: str, train: float = 0.8, val: float = 0.1, test: float = 0.1,
          seed: int = 42) -> DataFrame:
    """Exact-count train/validation/test split.

    Held-out sizes follow the public ``train_test_split`` rule:
    ``n_held = ceil((val+test) * n)``, then the held-out part is split again
    with ``n_test = ceil((1 - val/(val+test)) * n_held)``. In the order of
    (u(seed, key), key) the first ``n - n_held`` rows are train, the next
    ``n_held - n_test`` validation, the rest test. ``test == 0`` gives two
    splits. The two borders are thresholds (``quota.thresholds``), joined back
    as one broadcast row.
    """
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("Split ratios must sum to 1.0")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    held = F.ceil(F.lit(val + test) * F.col("n"))
    first = F.col("n") - held
    second = first + held - F.ceil(F.lit(1 - val / (val + test)) * held) if test > 0 else F.col("n")
    ranks = n.select(F.explode(F.array(F.struct(F.lit("train").alias("name"), first.cast("long").alias("rank")),
                                       F.struct(F.lit("val").alias("name"), second.cast("long").alias("rank")))).alias("r")).select("r.*")
    found = Q.thresholds(df, [], ranks, key_col, seed)
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    cuts = found.agg(*[of(name, c).alias(f"__{name}_{c}") for name in ("train", "val") for c in ("u_cut", "key_cut")])
    up_to = lambda name: F.coalesce(Q.within(F.col(key_col), F.col(f"__{name}_u_cut"), F.col(f"__{name}_key_cut"), seed), F.lit(False))
    label = F.when(up_to("train"), F.lit("train")).when(up_to("val"), F.lit("validation")).otherwise(F.lit("test"))
    return df.crossJoin(F.broadcast(cuts)).select(*df.columns, label.alias("split"))


def random_sample(df: DataFrame, n: int, key_col: str, seed: int = 42) -> DataFrame:
    """N rows with the smallest u; everything when n >= size."""
    quotas = df.sparkSession.createDataFrame([(n,)], "quota long")
    return Q.smallest(df, [], quotas, key_col, seed)


def stratified_sample(df: DataFrame, n: int, label_col: str, key_col: str, seed: int = 42) -> DataFrame:
    """Per label max(1, int(n * count/N)); when the total exceeds n,
    every quota is scaled by n/total, floored, at least 1. Not topped up."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    everything = Window.partitionBy()
    k = F.greatest(F.lit(1), F.floor(F.lit(n) * (F.col("c") / F.sum("c").over(everything))))
    q = counts.select(label_col, "c", k.alias("k"))
    total = F.sum("k").over(everything)
    q = q.select(label_col, F.least(F.col("c"), F.when(total > n, F.greatest(F.lit(1), F.floor(F.col("k") * (F.lit(n) / total))))
                                     .otherwise(F.col("k"))).alias("quota"))
    return Q.smallest(df, [label_col], q, key_col, seed)


def systematic_sample(df: DataFrame, order_col: str, k: int = 1000) -> DataFrame:
    """Every (len // k)-th row in ``order_col`` order, the first k of them
    (k = min(k, len)); an empty input stays empty."""
    ranked = global_row_number(df, [order_col], "__rn")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    size = F.least(F.lit(k), F.col("__n"))
    step = F.floor(F.col("__n") / size)
    j = ranked.crossJoin(F.broadcast(n))
    return j.filter(((F.col("__rn") - 1) % step == 0) & ((F.col("__rn") - 1) / step < size)).drop("__rn", "__n")


def mix(datasets: dict[str, DataFrame], ratios: dict[str, float], key_col: str, seed: int = 42,
        shuffled: bool = True) -> DataFrame:
    """Sample int(ratio/sum * min_len * n_sets) rows from each set (all when
    smaller), tag ``source_dataset``; ``shuffle_rank`` is the row's place in
    the seeded shuffle of the mix."""
    total_ratio = sum(ratios.values())
    counts = None
    for name, d in datasets.items():
        c = d.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    min_len = counts.agg(F.min("n").alias("min_len"))
    parts = None
    for name, ratio in ratios.items():
        if name not in datasets:
            continue
        size = min_len.select(F.floor(F.lit(ratio / total_ratio) * F.col("min_len") * len(datasets)).alias("quota"))
        s = Q.smallest(datasets[name], [], size, key_col, seed).withColumn("source_dataset", F.lit(name))
        parts = s if parts is None else parts.unionByName(s, allowMissingColumns=True)
    if not shuffled:
        return parts
    order = F.concat_ws("|", "source_dataset", F.col(key_col).cast("string"))
    return global_row_number(parts.withColumn("__u", T.u(seed, order)), ["__u", "source_dataset", key_col], "shuffle_rank").drop("__u")


def length_bucket(text: Column) -> Column:
    n = T.word_count(text)
    return F.when(n <= 100, F.lit("short")).when(n <= 300, F.lit("medium")).otherwise(F.lit("long"))


def balance_by_length(df: DataFrame, text_col: str, key_col: str, distribution: dict | None = None,
                      seed: int = 42) -> DataFrame:
    """Target int(total * ratio) per bucket; buckets below target keep all."""
    distribution = distribution or {"short": 0.3, "medium": 0.5, "long": 0.2}
    b = df.withColumn("length_bucket", length_bucket(F.col(text_col)))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    spark = df.sparkSession
    targets = spark.createDataFrame([(k, float(v)) for k, v in distribution.items()], "length_bucket string, ratio double")
    q = targets.crossJoin(total).select("length_bucket", F.floor(F.col("total") * F.col("ratio")).alias("quota"))
    return Q.smallest(b, ["length_bucket"], q, key_col, seed)


def fixed_groups(df: DataFrame, order_col: str, size: int) -> DataFrame:
    """Consecutive groups of ``size`` rows: group_id, position, group_size."""
    ranked = global_row_number(df, [order_col], "__rn")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    gid = F.floor((F.col("__rn") - 1) / size)
    return ranked.crossJoin(F.broadcast(n)).select(
        *df.columns, gid.alias("group_id"), ((F.col("__rn") - 1) % size).alias("position"),
        F.least(F.lit(size), F.col("__n") - gid * size).alias("group_size"))


def balance_labels(df: DataFrame, label_col: str, key_col: str, tolerance: float = 0.1, seed: int = 42) -> DataFrame:
    """Both classes down to int(min_class * (1 + tolerance))."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    everything = Window.partitionBy()
    q = counts.select(label_col, F.floor(F.min("c").over(everything) * (1 + tolerance)).alias("quota"))
    return Q.smallest(df, [label_col], q, key_col, seed)


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n: int, out: str = "rank") -> DataFrame:
    """First n rows per group; ``row_number <= n`` plans as a
    WindowGroupLimit, so each task keeps n rows per group before the shuffle."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def token_budget_batches(df: DataFrame, length_col: str, key_col: str, max_len: int,
                         shards: int | None = None) -> DataFrame:
    """Order-preserving batches bounded by ``len(batch) * max_len * 4``
    bytes over length-sorted shards (group-by-length).

    Rows are range-partitioned by length, then a grouped ``applyInPandas``
    walks each shard in (length, key) order and starts a new batch whenever
    the next row would exceed the budget ``budget_bytes``.
    """
    import pandas as pd

    n = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    budget = max_len * 4

    parted = df.select(key_col, length_col).repartitionByRange(n, length_col, key_col) \
        .withColumn("__shard", F.spark_partition_id())

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length_col, key_col])
        batch, used, out = 0, 0, []
        for ln in pdf[length_col].tolist():
            cost = max(int(ln), 1) * 4
            if used and used + cost > budget:
                batch += 1
                used = 0
            used += cost
            out.append(batch)
        pdf = pdf.assign(batch=out)
        return pdf[[key_col, length_col, "__shard", "batch"]]

    schema = f"{key_col} long, {length_col} long, __shard int, batch long"
    return parted.groupBy("__shard").applyInPandas(fold, schema)
