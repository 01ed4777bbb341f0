"""Session construction and lineage helpers.

The library never creates machine-local scratch folders on its own: a lineage cut goes to the
shared folder named by ``spark.checkpoint.dir``.  Only tests and the local bench call
:func:`local_session`, which sets a checkpoint folder when the session has none.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for this workload at scale:
# - AQE re-plans joins at runtime: a library key set that turns out small is broadcast
#   (runtime size check), skewed lake partitions (one hot size / hash) are split.
# - partial aggregation is Spark's default and pre-aggregates hot keys map-side.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # broadcast only after AQE has measured the real size of a side (not from plan estimates)
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # pinned (checkpointed) frames are deleted once no DataFrame refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder of the cluster, or None when the session names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    return None


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str | None:
    """Read ``spark.checkpoint.dir``; only when it is unset and ``allow_local`` (a single-JVM
    session: tests, local bench) choose a fresh scratch folder."""
    found = checkpoint_dir(spark)
    if found or not allow_local:
        return found
    path = tempfile.mkdtemp(prefix="tidemark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, now, and cut its lineage.

    The rows are written to the folder that ``spark.checkpoint.dir`` names (shared by the driver and all
    executors), so losing an executor later never re-reads or re-hashes content; the files go when
    nothing refers to the frame any more (``spark.cleaner.referenceTracking.cleanCheckpoints``).  A cluster
    session that names no such folder is an error: there is no weaker fallback.  A local session (one
    process) gets a scratch folder of its own.  ``localCheckpoint`` is never used.
    """
    spark = df.sparkSession
    if not ensure_checkpoint_dir(spark, allow_local=_is_local(spark)):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return df.checkpoint(eager=True)
