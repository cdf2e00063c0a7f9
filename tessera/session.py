"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill
in settings that are missing, never override what the cluster configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings this library relies on.  Applied only where the session leaves
# them unset (a cluster's own values always win).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # wide single-pass profiles (per-column moments, all-pairs correlation)
    # carry a few hundred aggregation-buffer fields; above this limit Spark
    # silently drops whole-stage code generation (≈6x slower aggregates)
    "spark.sql.codegen.maxFields": "1000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Local/test session.  The UI is off: no port beyond Spark's own RPC."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there; we read it from the
    session.  Only when nothing is configured AND the master is local (tests,
    single-machine runs) do we create a fresh scratch folder; on a cluster a
    missing setting is an error rather than a silent machine-local folder.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        # a machine-local folder is not visible to executors on other hosts
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
    local = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a fitted stage is reused by several later jobs and a lost
    executor must not force recomputation of a long lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
