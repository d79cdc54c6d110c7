"""Extension points: named stages, preprocessing hooks, templates and metrics of the caller."""

from __future__ import annotations

import json
import string
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .formats import render_template

Stage = Column | Callable[[DataFrame], DataFrame]

# ----------------------------------------------------------------- U1 / U2 stages


def preprocess(df: DataFrame, required: Sequence[str] = (), hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The caller's preprocessing after a check of the columns it needs; a missing one raises ValueError."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.transform(hook) if hook else df


def run_stages(df: DataFrame, stages: Sequence[tuple[str, Stage]], path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, counts)`` of named stages that are written to ``path`` in one pass.

    A stage is a predicate over columns (rows where it is not true go; the
    caller's own predicates, U3, are stages too) or a function from table to
    table. Every stage is counted by an ``Observation`` beside the write, so
    no second pass attributes rows to stages. ``counts`` has a row per stage:
    idx, stage, processed, filtered, filter_rate.
    """
    seen = []

    def watched(rows: DataFrame, name: str) -> DataFrame:
        seen.append(Observation(f"{name}-{uuid.uuid4().hex[:8]}"))
        return rows.observe(seen[-1], F.count(F.lit(1)).alias("n"))

    rows = watched(df, "source")
    for name, stage in stages:
        rows = watched(rows.filter(F.coalesce(stage, F.lit(False))) if isinstance(stage, Column) else stage(rows), name)
    rows.write.mode("overwrite").parquet(path)
    n = [o.get["n"] for o in seen]
    table = [(i, name, n[i], n[i] - n[i + 1], (n[i] - n[i + 1]) / n[i] if n[i] else 0.0) for i, (name, _) in enumerate(stages)]
    spark = df.sparkSession
    return spark.read.schema(rows.schema).parquet(path), spark.createDataFrame(
        table, "idx int, stage string, processed long, filtered long, filter_rate double")


# ----------------------------------------------------------------- U5 templates

TEMPLATES: dict[str, tuple[str, frozenset[str]]] = {}


def register_template(name: str, template: str) -> None:
    """A format string by name; its fields are what a row must give."""
    TEMPLATES[name] = (template, frozenset(f for _, f, _, _ in string.Formatter().parse(template) if f))


def render(name: str, **fields: Column) -> Column:
    """A registered template with a column for each of its fields."""
    template, wanted = TEMPLATES[name]
    if wanted - set(fields):
        raise ValueError(f"template {name} lacks fields: {', '.join(sorted(wanted - set(fields)))}")
    return render_template(template, **fields)


# ----------------------------------------------------------------- U4 metrics

@dataclass(frozen=True)
class Metric:
    """U4: a mergeable metric of the caller.

    ``zero()`` is an empty state, ``update(state, pdf)`` adds a batch with
    ``columns``, ``merge(a, b)`` joins two states, ``finish(state)`` gives
    the value (a number or None). States are what JSON can hold.
    """
    name: str
    columns: tuple[str, ...]
    zero: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


METRICS: dict[str, Metric] = {}
#: States that a task holds before it hands them on, and the salts of the first merge.
HELD_STATES, SALTS = 20_000, 64


def register_metric(metric: Metric) -> None:
    METRICS[metric.name] = metric


def evaluate(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The registered metrics per group: ``(by columns, metric, value)``, as partial aggregates.

    Each task updates states batch by batch and hands on one state per group
    and metric; these are merged by salts, then together, so the rows of a
    group, however many, never meet. Without ``by`` one row per metric, also
    for an empty table.
    """
    metrics = [METRICS[n] for n in names]
    by, kinds = list(by), dict(df.dtypes)
    needed = list(dict.fromkeys([*by, *(c for m in metrics for c in m.columns)]))
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def table(states: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k[0], k[1], json.dumps(v)) for k, v in states.items()], columns=[*by, "metric", "state"])

    def partial(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for pdf in blocks:
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for key, rows in groups:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                for m in metrics:
                    at = (key, m.name)
                    states[at] = m.update(states[at] if at in states else m.zero(), rows)
            if len(states) > HELD_STATES:
                yield table(states)
                states = {}
        yield table(states)

    def merged(pdf: pd.DataFrame) -> Any:
        m = METRICS_HERE[pdf.metric.iloc[0]]
        state = m.zero()
        for s in pdf.state:
            state = m.merge(state, json.loads(s))
        return state

    METRICS_HERE = {m.name: m for m in metrics}  # travels with the functions

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(state=json.dumps(merged(pdf)))

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        value = METRICS_HERE[pdf.metric.iloc[0]].finish(merged(pdf))
        return pdf.head(1)[[*by, "metric"]].assign(value=float("nan") if value is None else float(value))

    states = df.select(*needed).mapInPandas(partial, f"{keys}metric string, state string") \
        .withColumn("salt", F.spark_partition_id() % SALTS)
    if not by:
        zero = df.sparkSession.createDataFrame([(m.name, json.dumps(m.zero()), 0) for m in metrics],
                                               "metric string, state string, salt int")
        states = states.unionByName(zero)
    first = states.groupBy(*by, "metric", "salt").applyInPandas(join, f"{keys}metric string, state string, salt int")
    return first.groupBy(*by, "metric").applyInPandas(end, f"{keys}metric string, value double") \
        .withColumn("value", F.when(~F.isnan("value"), F.col("value")))
