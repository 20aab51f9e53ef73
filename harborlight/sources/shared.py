"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; without it a temporary folder, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="harborlight-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once where a plan uses it several times, and safe when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
