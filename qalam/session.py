"""Session helpers.

Cluster settings always win: a value already present on the session (for
example ``spark.checkpoint.dir`` pointing at a shared folder) is never
overwritten. Defaults below only fill gaps, which is what local tests need.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Defaults applied only when the session does not already define the key.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "qalam") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (builder.config("spark.driver.memory", os.environ.get("QALAM_DRIVER_MEMORY", "16g"))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in _DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    ensure_checkpoint_dir(spark)
    ship(spark)
    return spark


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, through Spark's own file distribution."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = _shipped[sc.applicationId] = tempfile.TemporaryDirectory()  # on the driver, which serves the file while it lives
    root = Path(__file__).resolve().parent
    to = Path(folder.name, f"{root.name}-lib.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster-named shared checkpoint folder (``spark.checkpoint.dir``)."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` from the session; set a local one only if unset.

    On a cluster the setting names a shared folder (HDFS/S3/ABFS) that
    survives executor loss; without it this raises. The local fallback
    exists for tests only and goes when the process ends.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="qalam-ckpt-", dir=os.environ.get("QALAM_LOCAL_TMP", "/tmp"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # core conf, not settable at runtime: the context dir below suffices
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured
