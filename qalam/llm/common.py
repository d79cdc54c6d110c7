"""Helpers shared by the operators: tables, shared-folder tables, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Rows and bytes of one Arrow batch: a batch of the longest texts must fit a Python worker.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, through Spark's own file distribution."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()  # on the driver, which serves the file while it lives
    _folders.append(folder)
    to = Path(folder.name, f"{root.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))


def prepare(spark: SparkSession) -> SparkSession:
    """Give the executors this package and bound the Arrow batches that Python workers hold."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone: nothing can reach the folder any more
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    This cuts the lineage: a lost executor loses no finished part, and every
    reader sees the same rows. The folder goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the folder of a table from :func:`written` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


# Word classes of bytes after lower-casing: ASCII letters and digits, and every
# byte of a non-ASCII character, belong to words; all other bytes separate them.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: The same words as a pattern over lower-cased strings.
WORD = r"[a-z0-9\x80-\U0010ffff]+"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << n.bit_length()
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, in order, without a loop over words."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * up[:-1], out=total[1:])
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles, from the hashes of the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + words[j:j + n]
    return _mixed(h)


class HashSet:
    """Membership of many 64-bit hashes in a small set: a bitmap first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = np.uint64(64 - min(24, max(12, len(self.keys).bit_length() + 6)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def where(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` whose hash is in the set."""
        at = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)])
        if not len(at):
            return at
        k = np.searchsorted(self.keys, h[at])
        return at[self.keys[np.minimum(k, len(self.keys) - 1)] == h[at]]
