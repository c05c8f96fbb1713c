"""Small results that a plan reads several times, kept as files all machines see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, purpose: str = "stored") -> str:
    """A new folder's name under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and all runs on one machine is a local folder chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="perilmap-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a new folder and read again: made once, its size known."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passing(df: DataFrame) -> DataFrame:
    """As ``stored``; what was shuffled for it goes as soon as it is written."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return stored(df)
    finally:
        spark.conf.set(key, before)
