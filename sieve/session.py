"""Spark session settings used by tests, the bench and the query catalog.

On a cluster the session is created by the platform; ``configure`` only fills
settings that are still unset, so cluster-provided values always win.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on. Values are defaults: an existing session keeps
# whatever the cluster configured.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts and vectors go to Python: a batch of 10,000 (Spark's own default) is tens of MB in
    # direct buffers and again in each worker, which keep that size while they are idle.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.session.timeZone": "UTC",
    # Per-target top-K keeps a partial limit before the shuffle only while K
    # is below this threshold; the reference selects up to 70,000 rows.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sieve`` importable in the Python workers (``--py-files`` at run
    time): zip the package once per driver process and add it to the context."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="sieve-pkg-")
    archive = os.path.join(out_dir, "sieve.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def configure(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    conf = spark.conf
    for key, value in DEFAULTS.items():
        try:
            if conf.get(key, None) in (None, ""):
                conf.set(key, value)
        except Exception:  # static conf on a running session: leave it
            pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. On a cluster ``spark.checkpoint.dir``
    names it and is used as is; a folder of our own is made only for a local
    master that has none, where driver and executors are one process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="sieve-ckpt-", dir=os.environ.get("SIEVE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sieve") -> SparkSession:
    """Session for tests and the bench (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SIEVE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
