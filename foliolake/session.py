"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the local benchmark. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliolake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder named by ``spark.checkpoint.dir``.

    Executors may be lost at any time, so lineage is only ever cut into storage that outlives them.
    A folder of our own is made for local masters only, where the setting is normally absent.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def shared(df: DataFrame) -> DataFrame:
    """Keep a relation that several branches of one plan read (recomputed if a block is lost)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
