"""The shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local master, as in tests, may do without that setting
    and gets a temporary one; on a cluster that is an error, since no other machine sees such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = f"file://{tempfile.mkdtemp(prefix='faultline-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there. Stages that use their input several times would compute it
    again for each use, and for each use of their output."""
    folder(df.sparkSession)
    return df.checkpoint()
