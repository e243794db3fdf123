"""Session helpers: building a session, shared scratch space, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_scratch: str | None = None


def build_session(app: str = "veneer", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on. AQE stays on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; taken from the session's checkpoint setting.

    A machine-local folder is only ever chosen for a local master.
    """
    global _local_scratch
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by the cluster")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="veneer-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def set_checkpoints(context) -> None:
    """Reliable checkpoints go below the shared folder."""
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(SparkSession.active()))


def cut_lineage(df: DataFrame, every_core: bool = False) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike executor-local blocks.

    ``every_core`` is for rows that take much work each: what was written in fewer partitions than there are cores is dealt out.
    """
    spark = df.sparkSession
    set_checkpoints(spark.sparkContext)
    out = df.checkpoint(eager=True)
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if every_core and out.rdd.getNumPartitions() < cores else out
