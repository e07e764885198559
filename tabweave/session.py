"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tabweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes and master come from the cluster's own settings."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, which driver and executors share (a local one only where none is set)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
