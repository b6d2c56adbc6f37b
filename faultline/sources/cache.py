"""Kept results: marts that are computed once, and small state beside them. All paths are of shared storage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class MartCache:
    """SRC10, SRC17, SRC20, SNK10: marts by name as Parquet (frames are never unpickled). A mart whose write did not end
    has no success mark and is computed again."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def get(self, name: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        """The stored mart, else (or with `refresh`) what build() returns, stored first."""
        if refresh or not self.has(name):
            build().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def input_key(df: DataFrame, *columns: str) -> str:
    """SNK09: a name for a cached summary that changes with the rows it sums up, whatever their order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64(*columns), F.lit(1 << 40))).alias("s"), F.bit_xor(F.xxhash64(*columns)).alias("x")).first()
    return hashlib.md5(json.dumps([row["n"], str(row["s"]), str(row["x"])]).encode()).hexdigest()


def unique_runs(sheet: DataFrame, column: str = "run_id") -> DataFrame:
    """SRC11: the distinct run ids of a release's report sheet; blanks are none."""
    return sheet.where(F.trim(F.coalesce(column, F.lit(""))) != "").select(F.col(column).alias("run_id")).distinct()


def read_config(path: str) -> dict:
    """SRC21: settings of a YAML file, or of a JSON one, on the driver."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}
