"""Exact quotas by thresholds.

The rows with the smallest (u, key) of each group are found without ranking
the group. ``u`` is 32 bits; a histogram of its first 12 bits per group tells
in which bin the quota ends, a histogram of the next 12 bits of that bin's
rows narrows it down, and only the rows that still tie are ordered. Their
place gives one threshold (u, key) per group, and the selection is a filter:
rows are neither sorted nor shuffled, and no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_checkpoint_dir

#: Threshold tables up to this many rows are broadcast (some 50 bytes each).
BROADCAST_ROWS = 50_000
_ALL = 1 << 32


def u32(seed: int, key: Column) -> Column:
    """``u(seed, key)`` as its 32 bits."""
    return (T.u(seed, key) * F.lit(float(_ALL))).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """A table with a row per group: broadcast if it is checked to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def thresholds(df: DataFrame, group_cols: list[str], ranks: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """``ranks`` (group columns, ``name``, ``rank``) with ``u_cut`` and ``key_cut``.

    The rows of a group with (u, key) up to the threshold are its first
    ``rank``: none for a rank below 1, all where there are no more. Keys are
    unique; groups that are null match nothing. The narrow (group, key, u)
    table is checkpointed once, so costly group expressions run once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    g = list(group_cols)
    narrow = df.select(*g, F.col(key_col).alias("_key"), u32(seed, F.col(key_col)).alias("_u")).checkpoint()
    ranks = ranks.select(*g, "name", F.col("rank").cast("long").alias("rank")).checkpoint()
    names = ranks.select(*g, "name", F.col("rank").alias("_left"))

    def step(rows: DataFrame, wanted: DataFrame, by: list[str], first: int, bits: int) -> DataFrame:
        """The bin of the next ``bits`` bits in which each wanted rank lies, and the rank within the bin."""
        bin_ = F.shiftright("_u", 32 - first - bits).bitwiseAND((1 << bits) - 1).alias(f"_b{first}")
        counts = rows.select(*by, bin_).groupBy(*by, f"_b{first}").agg(F.count(F.lit(1)).alias("_c"))
        near = counts.join(_small(wanted), by) if by else counts.crossJoin(F.broadcast(wanted))
        until = F.sum("_c").over(Window.partitionBy(*by, "name").orderBy(f"_b{first}"))
        return near.withColumn("_until", until).filter((F.col("_until") - F.col("_c") < F.col("_left")) & (F.col("_left") <= F.col("_until"))) \
            .select(*by, f"_b{first}", "name", (F.col("_left") - F.col("_until") + F.col("_c")).alias("_left")).checkpoint()

    one = step(narrow, names, g, 0, 12)
    rows = narrow.withColumn("_b0", F.shiftright("_u", 20))
    by = [*g, "_b0"]
    two = step(rows.join(_small(one.select(*by).distinct()), by, "left_semi"), one, by, 12, 12)
    by = [*by, "_b12"]
    tied = rows.withColumn("_b12", F.shiftright("_u", 8).bitwiseAND(4095)).join(_small(two), by)
    place = F.row_number().over(Window.partitionBy(*by, "name").orderBy("_u", "_key"))
    cut = tied.withColumn("_place", place).filter(F.col("_place") == F.col("_left")).select(
        *g, "name", F.col("_u").alias("u_cut"), F.col("_key").alias("key_cut"))
    found = ranks.join(cut, [*g, "name"], "left")
    return found.withColumn("u_cut", F.when(F.col("rank") < 1, -1).otherwise(F.coalesce("u_cut", F.lit(_ALL)))).checkpoint()


def within(key: Column, u_cut: Column, key_cut: Column, seed: int = 42) -> Column:
    """Whether (u, key) is at or before the threshold."""
    u = u32(seed, key)
    return (u < u_cut) | ((u == u_cut) & (key <= key_cut))


def smallest(df: DataFrame, group_cols: list[str], quotas: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """Per group of ``quotas`` (group columns, ``quota``) the rows of ``df`` with the smallest (u, key), as a filter.

    With more groups than are broadcast, the keys are selected first and
    ``df`` is semi-joined on its unique key, so no row meets its group.
    """
    g = list(group_cols)
    found = thresholds(df, g, quotas.select(*g, F.lit("").alias("name"), F.col("quota").alias("rank")), key_col, seed)
    keep = within(F.col(key_col), F.col("u_cut"), F.col("key_cut"), seed)
    cuts = found.select(*g, "u_cut", "key_cut")
    if not g:
        return df.crossJoin(F.broadcast(cuts)).filter(keep).drop("u_cut", "key_cut")
    if cuts.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(cuts), g).filter(keep).select(*df.columns)
    keys = df.select(*g, key_col).join(cuts, g).filter(keep).select(key_col)
    return df.join(keys, key_col, "left_semi")
