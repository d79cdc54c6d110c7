"""The few Arrow-batched Python functions (no native Spark equivalent)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC normalisation (vectorised over an Arrow batch)."""
    import unicodedata
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def lcs(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel.

    A token of ``x`` owns a mask of the places where it stands. ``open_``
    holds a 1 for every place that does not yet end a longer subsequence; a
    token of ``y`` clears, in each run of places, the first one it reaches:
    one addition and a few logical operations on len(x) bits at once.
    """
    masks: dict[str, int] = {}
    for i, token in enumerate(x):
        masks[token] = masks.get(token, 0) | 1 << i
    every = (1 << len(x)) - 1
    open_ = every
    for token in y:
        at = open_ & masks.get(token, 0)
        if at:
            open_ = ((open_ + at) | (open_ - at)) & every
    return len(x) - open_.bit_count()


@pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """I14 ROUGE-L helper: longest common subsequence of two token arrays; null arrays are empty."""
    tokens = lambda v: [] if v is None else list(v)
    return pd.Series([lcs(tokens(x), tokens(y)) for x, y in zip(a, b)], dtype="int64")
