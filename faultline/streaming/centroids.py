"""Centroid state kept up to date by a file stream of clustered runs.

State and ledger are versioned tables in one folder: a batch writes the next version, then the ledger's rows, so a
batch that is run again after a failure finds its runs in the ledger and does nothing (at least once, applied once).
Runs of a batch are folded in the order of their times: the average depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.functions import runs as R
from faultline.functions import text as T
from faultline.operators import cluster as C
from faultline.operators import regress as G
from faultline.operators import state as U
from faultline.sources.shared import cut

INPUT = "run_id string, type string, cluster_name string, embedding array<double>"
STATE = "type string, cluster_name string, centroid array<double>, weights map<string,double>"
MEMBERS = "run_id string, type string, cluster_name string, n long"
LEDGER = "run_id string, batch long"


class CentroidStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def centroids(self) -> DataFrame:
        return self._version("state", STATE)

    def members(self) -> DataFrame:
        """SNK05, CL22: which runs each cluster was met in, with the number of rows."""
        return self._version("members", MEMBERS)

    def _last(self) -> int | None:
        return self.ledger().agg(F.max("batch").alias("b")).first()["b"]

    def _version(self, name: str, schema: str) -> DataFrame:
        done = self._last()
        return self.spark.createDataFrame([], schema) if done is None else self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={done}")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """ST01, ST05, CL22, CL25: folds the batch's new runs into the state, and marks them after it is written. Token
        weights are those of a `text` column, if the batch has one. Each run's state is cut off from the one before, so
        a long batch makes no long plan."""
        fresh = G.pending(batch, self.ledger(), "run_id").where("cluster_name is not null and embedding is not null").persist()
        keys = ["type", "cluster_name"]
        try:
            order = [r["run_id"] for r in fresh.select("run_id").distinct().orderBy(R.embedded_time(F.col("run_id")), "run_id").collect()]
            if not order:
                return
            state = self.centroids()
            for run in order:
                rows = fresh.where(F.col("run_id") == run).withColumn("_key", F.struct(*keys))
                new = C.centroids(rows, "_key", "embedding").select("_key.type", "_key.cluster_name", "centroid")
                dense = U.updated_centroids(state, new, keys)
                sparse = U.updated_weights(state.where("weights is not null"), self._weights(rows), keys)
                state = cut(dense.join(sparse, keys, "left"))
            last = self._last()
            number = 0 if last is None else last + 1
            met = fresh.groupBy("run_id", *keys).agg(F.count(F.lit(1)).alias("n"))
            U.added_members(self.members(), met, ["run_id", *keys]).write.mode("overwrite").parquet(f"{self.folder}/members/batch={number}")
            state.write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")
            self.spark.createDataFrame([(r, number) for r in order], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        finally:
            fresh.unpersist()

    def _weights(self, rows: DataFrame) -> DataFrame:
        """AG16: mean token weights of a run's clusters."""
        if "text" not in rows.columns:
            return self.spark.createDataFrame([], "type string, cluster_name string, weights map<string,double>")
        numbered = rows.withColumn("_id", F.monotonically_increasing_id()).select("_id", "_key", "text").transform(cut)
        weights = C.token_weights(numbered, "_id", T.sparse_tokens(F.col("text"))).join(numbered.select("_id", "_key"), "_id")
        means = C.weight_maps(C.sparse_centroids(weights, "_id", "_key"), "_key")
        return means.select("_key.type", "_key.cluster_name", "weights")


def start(spark: SparkSession, source: str, folder: str) -> StreamingQuery:
    """ST01 to ST04: processes the files that are there, each once, and stops; a scheduler calls it again."""
    store = CentroidStore(spark, folder)
    rows = spark.readStream.schema(INPUT).parquet(source)
    return rows.writeStream.foreachBatch(store.apply).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start()


class Worker:
    """ST02: the stream's life: start() does nothing while it runs, stop() nothing where it doesn't."""

    def __init__(self, spark: SparkSession, source: str, folder: str) -> None:
        self.spark, self.source, self.folder = spark, source, folder
        self.query: StreamingQuery | None = None

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self) -> StreamingQuery:
        if not self.running:
            self.query = start(self.spark, self.source, self.folder)
        return self.query

    def stop(self) -> None:
        if self.running:
            self.query.stop()
        self.query = None


def failure_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The hourly monitor as a stream: results by type and event-time window, late rows within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "FAIL").alias("failed")).select(F.col("w.start").alias("window_start"), "type", "total", "failed")
