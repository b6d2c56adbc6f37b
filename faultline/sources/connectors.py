"""Sources and sinks of the triage engine; everything a job reads or writes goes through Spark's own readers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: result columns, all typed; missing optional ones are read as NULL.
RESULT_SCHEMA = "row_id bigint, run_id string, tc_uuid string, type string, runtime string, soc string, host string, model string, result string, exec_status string, reason string, log_path string, cluster_name string, cluster_class string, score string, run_month string"
HOST_COLUMNS = ("host", "hostname", "host_name", "machine", "node")


class ChangeService(Protocol):
    """SRC13: change details by id; the default reads them from a table."""

    def changes(self, ids: DataFrame) -> DataFrame: ...


class JobService(Protocol):
    """SRC16: running jobs; the default reads JSON files."""

    def jobs(self) -> DataFrame: ...


class TableChanges:
    def __init__(self, changes: DataFrame) -> None:
        self.table = changes

    def changes(self, ids: DataFrame) -> DataFrame:
        return self.table.join(ids.select("change_id").distinct(), "change_id", "left_semi")


class JsonJobs:
    def __init__(self, spark: SparkSession, path: str, schema: str = "run_id string, state string, started timestamp_ntz") -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def jobs(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.path)


def read_results(spark: SparkSession, path: str, kind: str = "parquet", months: list[str] | None = None) -> DataFrame:
    """SRC01, SRC03, SRC04, SRC06: a table of results; months prune its partitions. `result` is required."""
    reader = spark.read.option("header", "true") if kind == "csv" else spark.read
    df = reader.format(kind).load(path)
    if "result" not in df.columns:
        raise ValueError("the input has no column named result")
    fields = [f.strip().split(" ") for f in RESULT_SCHEMA.split(",")]
    df = df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    return df.where(F.col("run_month").isin(months)) if months else df


def first_shard(df: DataFrame, priority: Column) -> DataFrame:
    """SRC03, SRC05: rows of the shard with the least priority that has any."""
    best = df.agg(F.min(priority).alias("_p"))
    return df.withColumn("_own", priority).join(F.broadcast(best)).where("_own = _p").drop("_own", "_p")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """SRC01 from a database, in parallel ranges; the credentials come from the caller's options."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: (path, content) of whole log files."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def log_tail(content: Column, lines: int = 10_000) -> Column:
    """SRC15: the last lines of a log."""
    parts = F.split(content, "\n")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - lines + 1, F.lit(1)), F.lit(lines)), "\n")


def log_error(content: Column) -> Column:
    """SRC14: the error message of a JSON result, else the tail of the text."""
    return F.coalesce(F.get_json_object(content, "$.error_msg"), log_tail(content))


def with_full_reasons(df: DataFrame, logs: DataFrame) -> DataFrame:
    """CL02: truncated reasons replaced by what their logs say, by one join on the path."""
    cut = F.coalesce(F.lower("reason").contains("limiting reason"), F.lit(False))
    found = logs.select(F.col("path").alias("log_path"), log_error(F.col("content")).alias("_full"))
    return df.join(found, "log_path", "left").withColumn("reason", F.when(cut, F.coalesce("_full", "reason")).otherwise(F.col("reason"))).drop("_full")


def host_column(df: DataFrame) -> str | None:
    """SC36: the first of the candidate columns that exists."""
    return next((c for c in HOST_COLUMNS if c in df.columns), None)


def change_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: (run_id, pos, change_id) from JSON objects of lists."""
    raw = spark.read.option("wholetext", "true").text(path)
    runs = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("run_id", "ids"))
    return runs.select("run_id", F.posexplode("ids").alias("pos", "change_id"))


def write_by_cluster(df: DataFrame, path: str) -> None:
    """SNK01: one folder per named cluster; rows without one are left out, as the sheet export does."""
    named = df.where(F.trim(F.coalesce("cluster_name", F.lit(""))) != "").withColumn("cluster", F.substring("cluster_name", 1, 31))
    named.repartition("cluster").write.mode("overwrite").option("header", "true").partitionBy("cluster").csv(path)


def write_state(df: DataFrame, path: str) -> None:
    """SNK04: only the types that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type").parquet(path)


def add_membership(members: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK05."""
    return members.unionByName(new.join(members, keys, "left_anti").select(members.columns))


def publish(spark: SparkSession, version: str, pointer: str) -> None:
    """SNK06: readers follow a one-row pointer to the current version, which is replaced in one write."""
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(pointer)


def published(spark: SparkSession, pointer: str) -> str:
    return spark.read.schema("version string").json(pointer).first()["version"]
