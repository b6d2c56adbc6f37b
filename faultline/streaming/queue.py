"""A work queue in a shared folder, and jobs that take from it: first in, first out, each entry once."""

from __future__ import annotations

import concurrent.futures
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import runs as R
from faultline.sources.cache import exists

ENTRIES, DONE, FAILED = "run_id string, place long", "run_id string, state string", "run_id string, message string"


class JobQueue:
    """API05, ST03: run ids to work on. Entries, what is done, and failures are tables that only grow."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRIES)

    def add(self, ids: list[str]) -> None:
        """New ids in the given order; those that wait already, or are twice in the list, are left out."""
        waiting = {r["run_id"] for r in self.pending().collect()}  # one request's worth of work
        fresh = [i for i in dict.fromkeys(ids) if i not in waiting]
        if not fresh:
            return
        first = (self.entries().agg(F.max("place").alias("p")).first()["p"] or 0) + 1
        self._append("entries", self.spark.createDataFrame([(i, first + k) for k, i in enumerate(fresh)], ENTRIES).coalesce(1))

    def pending(self) -> DataFrame:
        """Entries that were added more often than they were finished, by their last place."""
        added = self.entries().groupBy("run_id").agg(F.count(F.lit(1)).alias("a"), F.max("place").alias("place"))
        done = self._read("done", DONE).groupBy("run_id").agg(F.count(F.lit(1)).alias("d"))
        return added.join(done, "run_id", "left").where(F.col("a") > F.coalesce("d", F.lit(0))).select("run_id", "place")

    def failures(self) -> DataFrame:
        return self._read("failed", FAILED)

    def drain(self, work: Callable[[str], None], wanted: Callable[[str], bool] = lambda _: True, limit: float | None = None) -> list[tuple[str, str]]:
        """ST03, ST04, ST07, ST08: works on what waits, in order, and ends: a scheduler calls it again. Each entry leaves
        the queue whatever becomes of it; a failure, or a job longer than `limit` seconds, is logged and the rest go on.
        Returns (run id, state): done, failed, late or skipped."""
        out = []
        for row in self.pending().orderBy("place", "run_id").collect():  # run ids, not rows
            run = row["run_id"]
            state = run_job(lambda run=run: work(run), limit) if wanted(run) else ("skipped", "")
            if state[0] in ("failed", "late"):
                self._append("failed", self.spark.createDataFrame([(run, f"Run ID: {run}\nFailed with error: {state[1]}\n")], FAILED).coalesce(1))
            self._append("done", self.spark.createDataFrame([(run, state[0])], DONE).coalesce(1))
            out.append((run, state[0]))
        return out

    def requeue(self) -> list[str]:
        """J05, SC38: runs that the failure log names wait again; the log begins anew."""
        log = self.failures().agg(F.array_join(F.collect_list("message"), "\n").alias("log"))
        ids = sorted({i for r in log.select(R.failed_runs(F.col("log")).alias("ids")).collect() for i in r["ids"] or []})
        self.spark.createDataFrame([], FAILED).write.mode("overwrite").parquet(f"{self.folder}/failed")
        self.add(ids)
        return ids


def run_job(work: Callable[[], None], limit: float | None = None) -> tuple[str, str]:
    """ST08: (state, message) of a job: done, failed, or late if it takes more than `limit` seconds (its thread is left
    to end by itself)."""
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        pool.submit(work).result(timeout=limit)
    except concurrent.futures.TimeoutError:
        return "late", f"more than {limit} s"
    except Exception as error:
        return "failed", "".join(traceback.format_exception_only(error)).strip()
    finally:
        pool.shutdown(wait=False)
    return "done", ""
