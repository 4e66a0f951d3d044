"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.schema import TesseraError


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may do without, there it is a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise TesseraError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/tessera-{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut an iteration's lineage by a checkpoint in the shared folder."""
    df.sparkSession.sparkContext.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
