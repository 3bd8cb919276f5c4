"""Session defaults and the shared folder that holds staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # A join on (s, date) may use rows that are already partitioned by date.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "tickloom", **settings: str) -> SparkSession:
    """A session with the library defaults; ``settings`` win over them.

    Keyword names use double underscores for dots, for instance
    ``spark__sql__shuffle__partitions="4000"``.
    """
    builder = SparkSession.builder.appName(app_name)
    for name, value in SESSION_DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides, or the folder given to ``setCheckpointDir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where one plan would otherwise read its input twice (carry tables,
    range-partitioned rows). Compared with ``persist`` the result survives lost
    executors, and as parquet it keeps column pruning and gives the optimizer
    true sizes, so that joins against it are broadcast only when really small.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
